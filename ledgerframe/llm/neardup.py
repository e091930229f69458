"""Operator 9: near-duplicate classes by consistent weighted sampling.

* A document is a bag of five-word shingles (lower-cased, split at white space); a
  shingle weighs its count in the document times a damped inverse document frequency.
  Document frequencies come from hashed counters over all documents, of fixed size: the
  average load of a counter is taken off, and what occurs in less than one of ``RARE``
  documents counts as equally rare, so strangers on a counter (about one in 8000
  documents' worth at 500 shingles a document, at any size of the corpus) do not matter.
  The damping keeps weights within a factor of 1.25: with the plain logarithm a large
  group of near copies would itself make the text that its members share nearly
  weightless, and break up.
* Consistent weighted sampling gives ``BANDS * ROWS`` samples a document; two documents agree on one with the probability of their weighted
  Jaccard similarity.  Documents that agree on all samples of a band meet in a bucket.
* A bucket's pairs are verified on the two whole texts: linked where their weighted
  Jaccard similarity is at least the threshold.  First come the edges of a spanning
  forest of the likest members, so a group of near copies costs a number of pairs in
  proportion to its size.  Then all pairs whose ends are still in different components
  follow, the likest of each member first, but for those that an exact bound rules out:
  shingle weights are summed by cells of a hash, and no two texts share more than the
  smaller sums.  Nothing is left out by an estimate; likeness in samples gives the order.
* Equal texts are one node from the start, however many there are.  Classes are the
  connected components of the links.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, cut, sliced
from .words import Memo

WORDS, BANDS, ROWS = 5, 20, 5
SAMPLES = BANDS * ROWS
COUNTERS = 1 << 22
CHUNK = 1 << 16
DAMPING, RARE = 0.25, 1000
SLOTS = 1 << 18
#: Members of a bucket that one task compares at a time, about.
LARGE = 512
#: What a bucket's member carries: the samples' low bytes and the weight of all its shingles.
SIG = np.dtype([("low", np.uint8, SAMPLES), ("weight", "<f4")])
_U = np.uint64


def _word(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_FACTORS = _mix(np.arange(1, WORDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_MEMO = Memo(_word, 200_000)


def occurrences(text: str | None) -> np.ndarray:
    """Hashes of a whole text's shingles, each as often as it occurs; a text of fewer words is one shingle, an empty one has none."""
    words = (text or "").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    w = np.fromiter(map(_MEMO.__getitem__, words), _U, n)
    k = min(n, WORDS)
    h = np.zeros(n - k + 1, _U)
    for j in range(k):
        h += w[j : n - k + 1 + j] * _FACTORS[j]
    return _mix(h)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a whole text's shingles."""
    h = np.sort(occurrences(text))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h)))


def rarity(docs: DataFrame) -> np.ndarray:
    """By counter: how rare its shingles are, 0 (in every document) to 255 (in one of ``RARE`` or fewer).

    Each task counts its documents' shingles; the counts are added up by chunk on the
    executors, and only their sum (16 MB, whatever the corpus) is collected.
    """

    def count(batches):
        counts, n = np.zeros(COUNTERS, np.uint32), 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts[(occurrences(text) & _U(COUNTERS - 1)).astype(np.int64)] += 1  # a counter that is named twice goes up by one
            n += batch.num_rows
        used = [k for k in range(COUNTERS // CHUNK) if counts[k * CHUNK : (k + 1) * CHUNK].any()]
        data = [zlib.compress(counts[k * CHUNK : (k + 1) * CHUNK].astype("<u4").tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int32()), pa.array([n] + [0] * len(used), pa.int64()), pa.array([None, *data], pa.binary())], ["chunk", "n", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for k, more, data in zip(*(c.to_pylist() for c in batch.columns)):
                n += more
                if data is not None:
                    x = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
                    sums[k] = sums[k] + x if k in sums else x
        data = [zlib.compress(np.minimum(x, 2**32 - 1).astype("<u4").tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *sums], pa.int32()), pa.array([n] + [0] * len(data), pa.int64()), pa.array([None, *data], pa.binary())], ["chunk", "n", "data"])

    schema = "chunk int, n long, data binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).toArrow()
    seen, n = np.zeros(COUNTERS), 0
    for k, more, data in zip(*(c.to_pylist() for c in parts.columns)):
        n += more
        if data is not None:
            seen[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(zlib.decompress(data), "<u4")
    seen = np.maximum(seen - seen.mean(), max(1.0, n / RARE))
    return np.round(255 * np.clip(np.log(max(n, 1) / seen) / np.log(RARE), 0, 1)).astype(np.uint8)


def weights(hashes: np.ndarray, counts: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Term frequency times damped inverse document frequency."""
    return counts * (1 + DAMPING / 255 * rare[(hashes & _U(COUNTERS - 1)).astype(np.int64)])


def cells(hashes: np.ndarray, weight: np.ndarray) -> tuple[bytes, float]:
    """Weights summed by cells, four to eight times as many as shingles (256 to 8192), rounded up: (whole numbers, size of one)."""
    n = 1 << int(np.clip(np.ceil(np.log2(len(hashes))) + 2, 8, 13))
    sums = np.bincount(((hashes >> _U(24)) & _U(n - 1)).astype(np.int64), weight, n)
    step = np.nextafter(np.float32(sums.max() / 255), np.float32(np.inf))
    return np.minimum(np.ceil(sums / step), 255).astype(np.uint8).tobytes(), float(step)


class Sampler:
    """Consistent weighted sampling by points in time.

    In each sample a shingle has points at random times (one in a unit of time, on average,
    for each unit of weight), each at a random height; a document sees those no higher than
    the shingle's weight, and its sample is the earliest it sees.  So two documents agree
    with the probability of their weighted Jaccard similarity.  Two units of weight are a
    row; the halves of one hash are the times of the units' first points.  Most of the work
    is a least hash over whole units; of the others only what comes earlier is looked at.
    """

    def __init__(self) -> None:
        self.factor = _mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
        self.offset = _mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0xE7037ED1A0B428DB))

    @staticmethod
    def rows(hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, height of the first unit that is seen, of the second); rows with a whole first unit come first."""
        more = np.flatnonzero(weight > 2)
        if len(more):
            n = np.ceil(weight[more] / 2).astype(np.int64) - 1
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            of = np.repeat(more, n)
            hashes = np.concatenate([hashes, _mix(hashes[of] + j.astype(_U) * _U(0x9E3779B97F4A7C15))])
            weight = np.concatenate([weight, weight[of] - 2 * j])
        if (part := weight < 1).any():
            order = np.argsort(part, kind="stable")
            hashes, weight = hashes[order], weight[order]
        return hashes, np.minimum(weight, 1), np.clip(weight - 1, 0, 1)

    def samples(self, hashes: np.ndarray, weight: np.ndarray, block: int = 512) -> np.ndarray:
        """SAMPLES 64-bit values; equal for two documents with their similarity's probability."""
        best, out = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, _U)
        every = np.arange(SAMPLES)
        hashes, *seen = self.rows(hashes, weight)
        whole = int(np.searchsorted(-seen[0], -1, "right"))
        work = np.empty((2, SAMPLES * min(block, len(hashes))), _U)
        for at in range(0, len(hashes), block):
            h, first, second = (x[at : at + block] for x in (hashes, *seen))
            x, y = (z[: SAMPLES * len(h)].reshape(SAMPLES, -1) for z in work)
            np.multiply(h[None, :], self.factor[:, None], out=x)
            x += self.offset[:, None]
            x ^= np.right_shift(x, _U(29), out=y)
            x *= _U(0xBF58476D1CE4E5B9)
            n = min(max(0, whole - at), len(h))
            if n:
                k = x[:, :n].argmin(1)
                self._earlier(best, out, every, _time(x[every, k] >> _U(32)), _mix(h[k] ^ _U(33)))
            limit = np.ceil(-np.expm1(-best) * 2.0**32).clip(0, 2.0**32 - 1).astype(np.uint32)[:, None]
            self._points(best, out, x, h, second, divmod(np.flatnonzero(x.astype(np.uint32) <= limit), len(h)), 0)
            if n < len(h):
                i, k = np.nonzero((x[:, n:] >> _U(32)).astype(np.uint32) <= limit)
                self._points(best, out, x, h, first, (i, k + n), 32)
        return out

    @staticmethod
    def _earlier(best, out, sample, time, value) -> None:
        order = np.argsort(-time, kind="stable")  # of one sample's the earliest is written last
        order = order[time[order] < best[sample[order]]]
        best[sample[order]], out[sample[order]] = time[order], value[order]

    def _points(self, best, out, x, h, seen, where, shift: int) -> None:
        """The points of units of which ``seen`` is seen, while they may be the earliest of their sample."""
        i, k = where
        some = seen[k] > 0
        i, k = i[some], k[some]
        state = x[i, k]
        time = _time(state >> _U(shift) & _U(0xFFFFFFFF))
        value = h[k] ^ _U(shift + 1)
        while len(i):
            state, value = _mix(state + _U(shift + 1)), _mix(value)
            sees = (state >> _U(32)) * 2.0**-32 < seen[k]
            self._earlier(best, out, i[sees], time[sees], value[sees])
            time = time + _time(state & _U(0xFFFFFFFF))
            on = ~sees & (time < best[i])
            i, k, state, time, value = (y[on] for y in (i, k, state, time, value))


def _time(u: np.ndarray) -> np.ndarray:
    """Exponentially distributed times from 32-bit numbers."""
    return -np.log1p(-(u + 0.5) * 2.0**-32)


def signatures(docs: DataFrame, rare) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, key, ``sig`` (see ``SIG``), band keys, cells.

    Narrow.  What a task has made for a text already is null for its copies, as for texts without words.
    """

    def run(batches):
        sampler, seen = Sampler(), set()
        names = ["doc_id", "key", "sig", "bands", "cells", "step"]
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.float32()]
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                key = hashlib.sha256((text or "").encode()).digest()[:16]
                if key in seen:
                    rows.append((key, None, None, None, None))
                    continue
                seen.add(key)
                h, c = shingles(text)
                if not len(h):
                    rows.append((key, None, None, None, None))
                    continue
                w = weights(h, c, rare.value)
                s = sampler.samples(h, w)
                band = np.arange(1, BANDS + 1, dtype=_U)
                for j in range(ROWS):
                    band = _mix(band * _U(0x9E3779B97F4A7C15) + s.reshape(BANDS, ROWS)[:, j])
                made = np.zeros((), SIG)
                made["low"], made["weight"] = s & _U(0xFF), w.sum()
                rows.append((key, made.tobytes(), band.astype(np.int64), *cells(h, w)))
            if len(seen) > 500_000:
                seen.clear()
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, sig binary, bands array<long>, cells binary, step float")


def likeness(sig: np.ndarray, root: np.ndarray, threshold: float, block: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal samples) of members in different components whose weights allow the threshold, i > j."""
    low, weight = sig["low"], sig["weight"]
    out = []
    for at in range(0, len(sig), block):
        part = slice(at, at + block)
        w, v = weight[part, None], weight[None, : at + block]
        fits = (np.minimum(w, v) >= np.float32(threshold * 0.9999) * np.maximum(w, v)) & (root[part, None] != root[None, : at + block])
        i, j = np.nonzero(fits)
        before = i + at > j
        i, j = i[before] + at, j[before]
        out.append((i, j, (low[i] == low[j]).sum(1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(i: np.ndarray, j: np.ndarray, like: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest over the components, the likest first."""
    parent = list(range(int(root.max()) + 1))

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    chosen, left = [], len(set(root.tolist())) - 1
    order = np.argsort(-like, kind="stable")
    for k, a, b in zip(order.tolist(), root[i[order]].tolist(), root[j[order]].tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[a] = b
            chosen.append(k)
            left -= 1
            if not left:
                break
    return np.array(chosen, np.int64)


def within_bound(i: np.ndarray, j: np.ndarray, weight: np.ndarray, held: list[tuple[bytes, float]], threshold: float, block: int = 4096) -> np.ndarray:
    """Which pairs the cells do not rule out: what they may share is the sum of the smaller cells."""
    size = np.array([len(c) for c, _ in held])
    tables: dict[int, np.ndarray] = {}

    def folded(n: int) -> np.ndarray:
        """All members with at least ``n`` cells, in ``n`` cells."""
        if n not in tables:
            tables[n] = np.zeros((len(held), n), np.float32)
            for row, (c, s) in zip(tables[n], held):
                if len(c) >= n:
                    row[:] = np.frombuffer(c, np.uint8).reshape(-1, n).sum(0, np.float32) * np.float32(s)
        return tables[n]

    out, common = np.zeros(len(i), bool), np.minimum(size[i], size[j])
    for n in np.unique(common).tolist():
        which = np.flatnonzero(common == n)
        for cells_ in (n // 16, n):  # few cells rule most pairs out
            sums, step, left = folded(cells_), max(1, block * 64 // cells_), []
            for at in range(0, len(which), step):
                k = which[at : at + step]
                shared = np.minimum(sums[i[k]], sums[j[k]]).sum(1)
                left.append(k[shared * 1.0001 >= threshold / (1 + threshold) * (weight[i[k]] + weight[j[k]])])
            which = np.concatenate(left) if left else which
        out[which] = True
    return out


def first_places(i: np.ndarray, j: np.ndarray, like: np.ndarray, places: int) -> tuple[np.ndarray, bool]:
    """(which pairs are among the ``places`` likest of their later member, whether some member has more)."""
    order = np.lexsort((j, -like, i))
    new = np.ones(len(order), bool)
    new[1:] = i[order][1:] != i[order][:-1]
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < places], bool((place >= places).any())


def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with the root of their component so far."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    return members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def candidates(members: DataFrame, threshold: float, places: int | None) -> DataFrame:
    """Distinct pairs (a, b) of keys, and the parts (bucket, part) where some member has more than ``places``.

    ``members``: bucket, part, key, sig, root; a part of a bucket is compared in one task.
    Without ``places`` the pairs are a spanning forest; with them ``members`` has cells and step too.
    """
    names = ["bucket", "part", "key", "sig", "root", *(["cells", "step"] if places else [])]
    # dealt by a hash of the part: an exchange by the part itself would be left out as the
    # join's own, and where the join turns into a broadcast the part's rows lie in many tasks
    ordered = members.repartition(F.xxhash64("bucket", "part")).sortWithinPartitions("bucket", "part", "key").select(*names)

    def run(batches):
        at, rows, out, full = None, {}, set(), set()

        def close():
            keys, values = list(rows), list(rows.values())
            sig = np.frombuffer(b"".join(v[0] for v in values), SIG)
            number: dict[bytes, int] = {}
            root = np.array([number.setdefault(v[1], len(number)) for v in values])
            if len(number) < 2:
                return
            i, j, like = likeness(sig, root, threshold)
            if not len(i):
                return
            if places:
                good = within_bound(i, j, sig["weight"], [v[2:] for v in values], threshold)
                i, j, like = i[good], j[good], like[good]
                chosen, more = first_places(i, j, like, places)
                if more:
                    full.add(at)
            else:
                chosen = forest(i, j, like, root)
            out.update((keys[b], keys[a]) for a, b in zip(i[chosen].tolist(), j[chosen].tolist()))

        def sent():
            rows = [(a, b, None, None) for a, b in out] + [(None, None, *x) for x in full]
            out.clear()
            full.clear()
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], ["a", "b", "bucket", "part"])

        for batch in batches:
            for bucket, part, key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, part) != at:
                    if len(rows) > 1:
                        close()
                    at, rows = (bucket, part), {}
                rows[key] = rest  # a text may come several times
            if len(out) > 20_000:
                yield sent()
        if len(rows) > 1:
            close()
        yield sent()

    return ordered.mapInArrow(run, "a binary, b binary, bucket long, part long").distinct()


class Links:
    """The verified links between texts, made in rounds, and their components (node, root)."""

    def __init__(self, scratch: Scratch, docs: DataFrame, signed: DataFrame, named: DataFrame, rare, threshold: float) -> None:
        self.scratch, self.docs, self.signed, self.named, self.rare, self.threshold = scratch, docs, signed, named, rare, threshold
        self.roots = self.found = self.tested = None

    def _added(self, pairs: DataFrame) -> DataFrame | None:
        """Verify those of ``pairs`` that are new; the parts that hold more than ``candidates`` gave."""
        scratch = self.scratch
        more = pairs.where("a is null").select("bucket", "part")
        fresh = pairs.where("a is not null").select("a", "b")
        if self.tested is not None:
            fresh = scratch.cut(fresh.join(self.tested, ["a", "b"], "left_anti"), "near-fresh")
        if not fresh.isEmpty():
            good = scratch.cut(verified(fresh, self.docs, self.named, self.rare, self.threshold), "near-links")
            self.tested = fresh if self.tested is None else self.tested.unionByName(fresh)
            if not good.isEmpty():
                self.found = good if self.found is None else self.found.unionByName(good)
                before, self.roots = self.roots, components(self.found, scratch)
                scratch.drop(before)
        return None if more.isEmpty() else more

    def settle(self, members: DataFrame) -> None:
        """``members`` (bucket, part, key, sig): afterwards no pair of one part that may be linked is untested between two components."""
        scratch, threshold = self.scratch, self.threshold
        here = scratch.cut(rooted(members, self.roots), "near-rooted")
        self._added(scratch.cut(candidates(here, threshold, None), "near-pairs"))
        scratch.drop(here)
        places, left = 16, members
        while True:
            here = scratch.cut(rooted(left, self.roots), "near-rooted")
            open_ = here.groupBy("bucket", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket", "part")
            open_ = scratch.cut(open_, "near-open")
            if open_.isEmpty():
                return
            rows = here.join(open_, ["bucket", "part"])
            # of the cells only those of members may move: their places among SLOTS are broadcast
            slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot")
            some = self.signed.where("cells is not null").select("key", "cells", "step", slot).join(F.broadcast(rows.select(slot).distinct()), "slot", "left_semi")
            rows = rows.join(some.select("key", "cells", "step").dropDuplicates(["key"]), "key")
            more = self._added(scratch.cut(candidates(rows, threshold, places), "near-pairs"))
            scratch.drop(here)
            if more is None:
                return
            # all pairs of the other parts are tested
            places, left = places * 32, members.join(more, ["bucket", "part"])

    def opened(self, members: DataFrame) -> DataFrame:
        """``members`` with roots, of the buckets that hold different components."""
        rows = self.scratch.cut(rooted(members, self.roots), "near-rooted")
        open_ = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        return rows.join(open_, "bucket")

    def link(self) -> None:
        """All links of the buckets that ``signed`` makes.

        A bucket of more than ``LARGE`` members is dealt into parts by a hash of the key (of
        another kind in each bucket, so the parts of one group mix), and pairs are first
        looked for within the parts, which joins a large group at a cost in proportion to its
        size; then among all members of a bucket that are still in different components (see
        ``crossed``), so no link is lost.
        """
        scratch, n = self.scratch, F.count(F.lit(1)).alias("n")
        spread = self.signed.where("bands is not null").select("key", F.explode("bands").alias("bucket"))
        shared = scratch.cut(spread.groupBy("bucket").agg(n).where("n > 1"), "near-shared")
        sigs = self.signed.where("sig is not null").select("key", "sig").dropDuplicates(["key"])
        members = scratch.cut(dealt(spread, shared).join(sigs, "key").select("bucket", "part", "key", "sig"), "near-members")
        self.settle(members)
        large = members.join(shared.where(F.col("n") > LARGE).select("bucket"), "bucket").dropDuplicates(["bucket", "key"])
        large = scratch.cut(self.opened(large), "near-large")
        if not large.isEmpty():
            self.settle(scratch.cut(crossed(large, scratch), "near-members"))


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` of the buckets in ``sizes`` (bucket, n), with parts of about ``LARGE``."""
    part = F.pmod(F.xxhash64("key", "bucket"), F.ceil(F.col("n") / F.lit(LARGE)))
    return rows.join(sizes, "bucket").withColumn("part", part.cast("long")).drop("n")


def crossed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, part, key, sig: a part for every two cells of a bucket that may hold different components.

    ``rows``: bucket, key, sig, root.  A component of more than ``LARGE`` members has cells
    of its own, which are not compared with each other; other members share cells.
    """
    rows = scratch.cut(rows.select("bucket", "key", "sig", "root"), "near-rows")
    sizes = scratch.cut(rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    alone = sizes.where(F.col("n") > LARGE).select("bucket", "root", "n")
    mixed = scratch.cut(sizes.where(F.col("n") <= LARGE).groupBy("bucket").agg(F.sum("n").alias("m")), "near-mixed")
    slot = F.xxhash64("key", F.lit(-1))
    own = F.when(F.col("n").isNotNull(), F.col("root")).alias("own")
    cell = F.when(F.col("n").isNotNull(), F.xxhash64("root", F.pmod(slot, F.ceil(F.col("n") / F.lit(LARGE))))).otherwise(F.pmod(slot, F.ceil(F.col("m") / F.lit(LARGE)))).cast("long").alias("cell")
    rows = rows.join(alone, ["bucket", "root"], "left").join(mixed, "bucket", "left").select("bucket", "key", "sig", own, cell)
    rows = scratch.cut(rows, "near-cells")
    each = scratch.cut(rows.select("bucket", "own", "cell").distinct(), "near-cells")
    other = each.select("bucket", F.col("own").alias("own2"), F.col("cell").alias("cell2"))
    both = each.join(other, "bucket").where(F.col("cell") <= F.col("cell2")).where(F.col("own").isNull() | F.col("own2").isNull() | (F.col("own") != F.col("own2")))
    both = both.select("bucket", F.xxhash64("cell", "cell2").alias("part"), F.explode(F.array_distinct(F.array("cell", "cell2"))).alias("cell"))
    return rows.join(both, ["bucket", "cell"]).select("bucket", "part", "key", "sig")


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, rare, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose whole texts are similar enough.

    ``docs``: doc_id, text; ``named`` (key, least): the doc_id whose row has the text of a key.
    """

    def run(batches):
        kept: tuple[bytes, tuple] | None = None
        for batch in sliced(batches):
            good = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb"))):
                if kept is None or kept[0] != a:  # rows come sorted by a
                    h, c = shingles(ta)
                    kept = (a, (h, weights(h, c, rare.value)))
                (h, w), (g, d) = kept[1], shingles(tb)
                v = weights(g, d, rare.value)
                _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                shared, total = np.minimum(w[i], v[j]).sum(), w.sum() + v.sum()
                good.append(bool(shared >= threshold * (total - shared)))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ends = ends.join(named, "key").select("key", id_or_last("least"))
    # of the texts only those that may be in a pair move: their places among SLOTS are broadcast
    place = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")
    slots = ends.select(place).distinct()  # at most SLOTS rows
    texts = docs.select(id_or_last("doc_id"), "text").withColumn("slot", place).join(F.broadcast(slots), "slot", "left_semi")
    texts = texts.select(F.unhex(text_key("text")).alias("key"), "id", "text").join(ends, ["key", "id"]).dropDuplicates(["key", "id"])
    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").sortWithinPartitions("a").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node each node is connected with.

    Every round takes the least label among a node and its neighbours, then follows
    that label one step (which doubles the reach), and writes the labels down.
    """
    edges = scratch.cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = scratch.cut(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = scratch.cut(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), (F.least("next", F.coalesce("far", "next")) != F.col("root")).alias("moved")), "labels")
        labels = new.select("node", "root")
        if new.where("moved").limit(1).count() == 0:
            return labels


def text_key(column: str) -> Column:
    """What equal texts share: half of the SHA-256 of the text, in hex; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 256), 1, 32)


def id_or_last(column: str) -> Column:
    """A doc_id to join on; null, which is larger than any other, as the largest number."""
    return F.coalesce(F.col(column), F.lit((1 << 63) - 1)).alias("id")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept, text_key for every row.

    ``text_key`` is ``text_key(text)``.  Equal texts are always one class; null and
    empty texts are equal texts, and like no other.  ``kept`` is true for one row of a
    class: that with the class_id (of rows that repeat it, for one).  A null doc_id is
    larger than any other, so it is a class_id only where a class has no other.  An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with Scratch(spark) as scratch:
        rare = spark.sparkContext.broadcast(rarity(rows))  # a table of fixed size
        signed = scratch.cut(signatures(rows, rare), "near-signatures")
        named = scratch.cut(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "near-named")
        links = Links(scratch, rows, signed, named, rare, threshold)
        links.link()
        named = rooted(named, links.roots)
        whole = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
        named = named.join(whole, "root").select("key", "class_id", "class_size", "least")
        out = signed.select("doc_id", "key").join(named, "key")
        # of rows that repeat (doc_id, text) one is kept: those few are numbered, the others are not touched
        mine = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("doc_id").eqNullSafe(F.col("least"))
        out = out.select("doc_id", "class_id", "class_size", F.lower(F.hex("key")).alias("text_key"), mine.alias("mine"), F.monotonically_increasing_id().alias("at"))
        out = scratch.cut(out, "near")
        one = out.where("mine").groupBy("class_id").agg(F.min("at").alias("one"))
        out = out.join(one.withColumnRenamed("class_id", "c"), F.col("class_id").eqNullSafe(F.col("c")), "left")
        return cut(out.select("doc_id", "class_id", "class_size", (F.col("mine") & F.coalesce(F.col("at") == F.col("one"), F.lit(False))).alias("kept"), "text_key"), "near-classes")
