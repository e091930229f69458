"""Operator 10: exact dedup against an immutable snapshot.

Texts are equal when their bytes are, after lower-casing A-Z only.

* Each task first groups its own rows by the bytes themselves, so a text that a
  third of all rows hold leaves a task as one row.  Where very many tasks hold a text,
  their rows are merged in groups of bounded size first, again and again, so that no task
  gets it from all of them.
* A snapshot is two written tables that never change: exact buckets (digest, text)
  and, per bucket, a static binary-fuse filter over the bucket's digests.
* An incoming batch is grouped for itself first, by bucket.  The same task asks the
  bucket's filter about each distinct digest.  "No" is certain, and those groups are
  new; "maybe" goes on to the exact bucket, where digests are joined and bytes compared.
* Among equal texts the row with the largest doc_id stays.

Two texts that share a SHA-256 digest but differ in bytes stop the job with an error.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, cut, sliced

LOCAL = "digest binary, text binary, keep long, size long, local long, members array<long>"
HEAD = "bucket int, digest binary, text binary, keep long, size long, local long"
UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


class BinaryFuse:
    """Static filter over 64-bit keys: three places per key in neighbouring segments, 8-bit fingerprints.

    After Graf and Lemire, "Binary Fuse Filters" (2022).  No false negatives, about
    1 in 256 false positives, about 9 bits a key.
    """

    def __init__(self, seed: int, segment: int, span: int, prints: np.ndarray) -> None:
        self.seed, self.segment, self.span, self.prints = seed, segment, span, prints

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))

    @staticmethod
    def _places(h: np.ndarray, segment: int, span: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        if not n:
            return cls(0, 4, 0, np.zeros(0, np.uint8))
        segment = min(1 << 18, 1 << int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1, 200):
            if seed % 20 == 0:
                segments += 1 + segments // 8
            span = segments * segment
            h = cls._mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            if (prints := cls._peel(h, segment, span)) is not None:
                return cls(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, span, prints)
        raise RuntimeError("no seed gives a filter")

    @classmethod
    def _peel(cls, h: np.ndarray, segment: int, span: int) -> np.ndarray | None:
        places = cls._places(h, segment, span)
        size, n = span + 2 * segment, len(h)
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys at a place: the key itself where only one is left
        for row in places:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left, ready = [], n, np.flatnonzero(count == 1)
        while len(ready):
            keys, first = np.unique(owner[ready], return_index=True)
            own = ready[first]
            rounds.append((keys, own))
            left -= len(keys)
            touched = places[:, keys]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, keys)
            near = np.unique(touched.ravel())
            ready = near[count[near] == 1]
        if left:
            return None
        table, wanted = np.zeros(size, np.uint8), cls._prints(h)
        for keys, own in reversed(rounds):
            table[own] = 0
            a, b, c = places[:, keys]
            table[own] = wanted[keys] ^ table[a] ^ table[b] ^ table[c]
        return table

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        h = self._mix(np.asarray(keys, np.uint64), self.seed)
        a, b, c = self._places(h, self.segment, self.span)
        return self._prints(h) == self.prints[a] ^ self.prints[b] ^ self.prints[c]

    def to_bytes(self) -> bytes:
        return struct.pack("<QII", self.seed, self.segment, self.span) + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment, span = struct.unpack_from("<QII", data)
        return cls(seed, segment, span, np.frombuffer(data, np.uint8, offset=16))


def _keys(digests: list[bytes]) -> np.ndarray:
    """The filter's 64-bit keys: bytes 8 to 16 of the digests (bytes 0 to 8 choose the bucket)."""
    return np.array([int.from_bytes(d[8:16], "little") for d in digests], np.uint64)


def local_groups(docs: DataFrame, save=cut, held_mb: int = 48, chunk: int = 10_000) -> DataFrame:
    """Rows of ``docs`` grouped by their bytes within each task (in blocks of ``held_mb`` of texts and ids).

    A row has at most ``chunk`` members; members are sorted, largest doc_id first, nulls last.
    """

    def run(batches):
        base, made = TaskContext.get().partitionId() << 33, 0

        def flush(groups):
            nonlocal made
            rows = []
            for text, ids in groups.items():
                ids.sort(key=lambda x: (x is not None, x if x is not None else 0), reverse=True)
                digest = hashlib.sha256(text).digest()
                for at in range(0, len(ids), chunk):
                    part = ids[at : at + chunk]
                    rows.append((digest, text, part[0], len(part), base + made, part))
                    made += 1
            for at in range(0, len(rows), 2000):
                columns = list(zip(*rows[at : at + 2000]))
                kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "text", "keep", "size", "local", "members"])

        groups: dict[bytes, list] = {}
        held = 0
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (text or b"").translate(UPPER)
                ids = groups.get(text)
                if ids is None:
                    groups[text] = [doc_id]
                    held += len(text)
                else:
                    ids.append(doc_id)
                    held += 8
            if held > held_mb << 20:
                yield from flush(groups)
                groups, held = {}, 0
        yield from flush(groups)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return save(rows.mapInArrow(run, LOCAL), "dedup-local")


def _merge(t: pa.Table) -> dict[bytes, tuple]:
    """Equal digests of one bucket, bytes compared: digest -> (text, keep, size, local of the kept row)."""
    found: dict[bytes, tuple] = {}
    for digest, text, keep, size, local in zip(*(t.column(c).to_pylist() for c in ("digest", "text", "keep", "size", "local"))):
        have = found.get(digest)
        if have is None:
            found[digest] = (text, keep, size, local)
        elif have[0] != text:
            raise ValueError(f"two texts share the digest {digest.hex()}")
        else:
            # the largest doc_id; of repeated rows the smallest place
            best = max((have[1], -have[3]), (keep, -local), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            found[digest] = (text, best[0], have[2] + size, -best[1])
    return found


#: A task takes about so many buckets, so that tasks are alike in size.
BUCKETS_A_TASK = 8


#: A text in so many rows is merged in groups of about so many.
MANY = 64


def thinned(local: DataFrame, save=cut) -> DataFrame:
    """(digest, text, keep, size, local) with no digest in ``MANY`` rows or more: bytes are compared in each merge."""
    names = ["digest", "text", "keep", "size", "local"]
    heads = local.select(*names)

    def merge(t: pa.Table) -> pa.Table:
        found = _merge(t)
        columns = [list(found), *map(list, zip(*found.values()))]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, HEAD_KINDS[1:])], names)

    while True:
        many = save(heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY), "dedup-many")
        if many.isEmpty():
            return heads
        group = F.pmod(F.xxhash64("local"), F.ceil(F.col("n") / F.lit(MANY // 2))).alias("group")
        hot = heads.join(many, "digest").select(*names, group)
        merged = save(hot.groupBy("digest", "group").applyInArrow(merge, HEAD.removeprefix("bucket int, ")), "dedup-merged")
        heads = heads.join(many, "digest", "left_anti").select(*names).unionByName(merged)


def _heads(local: DataFrame, buckets: int) -> DataFrame:
    number = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    heads = local.select(F.pmod(number, F.lit(buckets)).cast("int").alias("bucket"), "digest", "text", "keep", "size", "local")
    return heads.repartition(-(-buckets // BUCKETS_A_TASK), "bucket")


HEAD_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
HEAD_NAMES = ["bucket", "digest", "text", "keep", "size", "local"]


class Snapshot:
    """Written exact buckets and their filters."""

    def __init__(self, exact: DataFrame, filters: DataFrame, buckets: int) -> None:
        self.exact, self.filters, self.buckets = exact, filters, buckets

    @classmethod
    def build(cls, local: DataFrame, buckets: int, save=cut) -> Snapshot:
        def merge(t: pa.Table) -> pa.Table:
            found = _merge(t)
            n = t.column("bucket")[0].as_py()
            columns = [[n] * len(found), list(found), *map(list, zip(*found.values()))]
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, HEAD_KINDS)], HEAD_NAMES)

        def index(t: pa.Table) -> pa.Table:
            made = BinaryFuse.build(_keys(t.column("digest").to_pylist())).to_bytes()
            return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})

        exact = save(_heads(local, buckets).groupBy("bucket").applyInArrow(merge, HEAD), "dedup-exact")
        filters = save(exact.select("bucket", "digest").groupBy("bucket").applyInArrow(index, "bucket int, filter binary"), "dedup-filters")
        return cls(exact, filters, buckets)

    def screen(self, local: DataFrame, save=cut) -> DataFrame:
        """The batch's own groups; ``maybe`` where the filter cannot rule out the snapshot (only those keep their text)."""

        def run(batch: pa.Table, filters: pa.Table) -> pa.Table:
            found = _merge(batch) if batch.num_rows else {}
            digests = list(found)
            if filters.num_rows and digests:
                maybe = BinaryFuse.from_bytes(filters.column("filter")[0].as_py()).contains(_keys(digests)).tolist()
            else:
                maybe = [False] * len(digests)
            rows = [(d, v[0] if m else None, v[1], v[2], v[3], m) for (d, v), m in zip(found.items(), maybe)]
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["digest", "text", "keep", "size", "local", "maybe"])

        tasks = -(-self.buckets // BUCKETS_A_TASK)
        left, right = _heads(local, self.buckets).groupBy("bucket"), self.filters.repartition(tasks, "bucket").groupBy("bucket")
        return save(left.cogroup(right).applyInArrow(run, "digest binary, text binary, keep long, size long, local long, maybe boolean"), "dedup-batch")


def text_key(column: str) -> Column:
    """``text_sha256`` of ``dedup`` as an expression."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), upper, upper.lower())
    return F.sha2(text.cast("binary"), 256)


def dedup(earlier: DataFrame, incoming: DataFrame, bucket_mb: int = 3) -> DataFrame:
    """Every row of both with its group: doc_id, keep_id, group_size, kept, text_sha256.

    ``earlier`` becomes the snapshot, ``incoming`` the batch screened against it.
    Null text counts as empty; a null doc_id is smaller than any other (keep_id is
    null where a group has no other); of rows repeated with the kept doc_id one is
    kept; empty tables give an empty result; other columns are ignored.
    """
    with Scratch(earlier.sparkSession) as scratch:
        return cut(_dedup(earlier, incoming, bucket_mb, scratch.cut), "dedup")


def _dedup(earlier: DataFrame, incoming: DataFrame, bucket_mb: int, save) -> DataFrame:
    spark = earlier.sparkSession
    old, new = local_groups(earlier, save), local_groups(incoming, save)
    total = sum(x.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] for x in (old, new))
    buckets = max(BUCKETS_A_TASK * spark.sparkContext.defaultParallelism, -(-total // (bucket_mb << 20)))
    snapshot = Snapshot.build(thinned(old, save), buckets, save)
    batch = snapshot.screen(thinned(new, save), save)
    s = snapshot.exact.select(F.col("digest").alias("sd"), F.col("text").alias("st"), F.col("keep").alias("sk"), F.col("size").alias("sn"), F.col("local").alias("sl"))
    b = batch.where("maybe").select(F.col("digest").alias("bd"), F.col("text").alias("bt"), F.col("keep").alias("bk"), F.col("size").alias("bn"), F.col("local").alias("bl"))
    # texts travel only to where a positive meets its bucket row: the rows without a partner need none
    met = s.join(b, s.sd == b.bd, "inner").select("sd", F.assert_true(F.col("st") == F.col("bt"), F.lit("two texts share a digest")).alias("same"), "bk", "bn", "bl")
    met = save(met.select("sd", "bk", "bn", "bl", F.col("same").isNull().alias("same")), "dedup-met")
    joined = s.drop("st").join(met.withColumnRenamed("sd", "md"), F.col("sd") == F.col("md"), "left")
    from_batch = F.col("bn").isNotNull() & (F.coalesce(F.col("bk") > F.col("sk"), F.col("bk").isNotNull() & F.col("sk").isNull()))
    old_groups = joined.select(
        F.col("sd").alias("digest"),
        F.when(from_batch, F.col("bk")).otherwise(F.col("sk")).alias("keep_id"),
        (F.col("sn") + F.coalesce("bn", F.lit(0))).alias("group_size"),
        F.when(from_batch, F.col("bl")).otherwise(F.col("sl")).alias("keeper"),
        F.when(from_batch, F.lit(1)).otherwise(F.lit(0)).alias("side"),
    )
    fresh = batch.join(met.select(F.col("sd").alias("digest")), "digest", "left_anti")
    new_groups = fresh.select("digest", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("local").alias("keeper"), F.lit(1).alias("side"))
    groups = old_groups.unionByName(new_groups)
    members = old.select("digest", "local", "members", F.lit(0).alias("of")).unionByName(new.select("digest", "local", "members", F.lit(1).alias("of")))
    rows = members.join(groups, "digest").select("digest", "local", "of", "keep_id", "group_size", "keeper", "side", F.posexplode("members").alias("at", "doc_id"))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("at") == 0) & (F.col("local") == F.col("keeper")) & (F.col("of") == F.col("side"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
