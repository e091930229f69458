"""Operator 2: a Katz backoff language model of any order over all training text.

A token's probability comes from its n-gram; where training has no such n-gram it backs
off to the next shorter history, and so on down to the single token.  Good-Turing
discounts (up to count ``K``, by order) free the mass, and each history's backoff weight
is what makes its probabilities sum to exactly one over the vocabulary and one unknown
token.  A document starts with one start mark, so its first tokens have short histories.

How it runs.  Texts become blocks: a block's documents as one stream of numbers into the
block's own vocabulary.  Blocks ask, and tables answer, order by order: a block sends its
distinct n-grams with their training counts, split by bucket; a bucket adds up what all
blocks sent, which makes its part of that order's table, and answers every block in the
order of its question with counts and, for each history, what its backoff weight is
made of.  So a distinct n-gram travels once per block, not once per occurrence, and the
model is never in one place.  A bucket is chosen by the history; a history with more
than ``hot`` occurrences is dealt over several buckets by its followers, and the sums of
its parts are added up and sent to the blocks that hold it.  Blocks do not ask for
n-grams whose history or whose shorter form training does not have.

A message between blocks and buckets is a row, so there are at most as many as distinct
n-grams per block, and far fewer while blocks hold many n-grams of each bucket.
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, crc_mod, cut

K = 5
END = b" end"  # no word holds a space
BLOCK = "block long, n_docs long, n_train long, tokens long, entries long, data binary"
ASK = "bucket int, block long, data binary"
ANSWER = "kind int, bucket int, block long, head binary, data binary, stats array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Kinds of answers: a bucket's table, an answer to a block, a part of a hot history, a block's wish for one.
TABLE, REPLY, PART, WISH = range(4)
STORED = -1  # the block number of a table that is asked again
_U = np.uint64
#: The type that holds numbers of so many bytes.
_WIDTHS = [None, np.uint8, np.uint16, *[np.uint32] * 2, *[np.uint64] * 4]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_(), "double": pa.float64()}


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one value: as many bytes of each number as the largest needs, by byte planes, compressed."""
    parts, compress = [], zstandard.ZstdCompressor(level=1).compress
    for x in map(np.asarray, arrays):
        size = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
        x = x.astype(_WIDTHS[size], copy=False)
        planes = np.empty((size, len(x)), np.uint8)
        for k in range(size):
            planes[k] = x >> x.dtype.type(8 * k) if k else x
        data = compress(planes)
        parts += [struct.pack("<BQ", size, len(data)), data]
    return b"".join(parts)


def _load(data: bytes) -> list[np.ndarray]:
    out, at, decompress = [], 0, zstandard.ZstdDecompressor().decompress
    while at < len(data):
        size, n = struct.unpack_from("<BQ", data, at)
        planes = np.frombuffer(decompress(data[at + 9 : at + 9 + n]), np.uint8).reshape(size, -1)
        x = planes[0].astype(_WIDTHS[size])
        for k in range(1, size):
            x |= planes[k].astype(x.dtype) << x.dtype.type(8 * k)
        out.append(x.astype(np.int64) if size < 8 else x)
        at += 9 + n
    return out


def _rows(rows: list, schema: str) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], _TYPES[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows by columns of whole numbers, the first counts most; and where, so ordered, a row differs from that before.

    Columns share a word with the row number where they fit, so that plain values are sorted.
    """
    n = len(columns[0])
    bits, order, word, used = max(1, n.bit_length()), None, None, 0

    def sorted_by(key, order):
        """(order, the ordered keys)"""
        key = key if order is None else key[order]
        if int(key.max()).bit_length() + bits > 63:
            step = np.argsort(key, kind="stable")
            key = key[step]
        else:
            key = np.sort(key << bits | np.arange(n))
            step = key & ((1 << bits) - 1)
            key >>= bits
        return step if order is None else order[step], key

    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    for c in reversed(columns):
        c = c.astype(np.int64, copy=False)
        size = int(c.max()).bit_length()
        if word is not None and used + size + bits > 63:
            order, word, used = sorted_by(word, order)[0], None, 0
        word, used = (c, size) if word is None else (c << used | word, used + size)
    whole = order is None
    order, key = sorted_by(word, order)
    return order, _starts([key] if whole else [c[order] for c in columns])


def _groups(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's combination in sorted order, a row of each)."""
    order, new = _order(columns)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return where, order[new]


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from that before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return new


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of SipHash of each word's bytes."""
    return pd.util.hash_array(words.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False)


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, their indices text after text, number of words of each text): A-Z
    lower-cased, split at ASCII white space."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten().dictionary_encode()
    found = flat.indices.to_numpy(zero_copy_only=False)
    counts = np.diff(words.offsets.to_numpy())
    empty = pc.index(flat.dictionary, "").as_py()
    if empty >= 0:  # white space at a text's ends leaves empty words
        real = found != empty
        counts = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(counts)])])
        found = found[real]
    return flat.dictionary, found, counts


def make_blocks(docs: DataFrame, tokens: int, rows: int = 400) -> DataFrame:
    """Blocks of whole documents (doc_id, text, train), about ``tokens`` tokens each; document bounds are kept.

    ``rows`` documents are split at a time, and a block ends between two such slices.
    """

    def run(batches):
        base, made = TaskContext.get().partitionId() << 24, 0
        end = _hashes(pa.array([END]))
        hashes, stream, lengths, ids, train = [end], [], [], [], []  # the words of each slice; the end comes before them
        held, size = 1, 0

        def closed():
            # the vocabulary goes in the order of its hashes
            every, where = np.unique(np.concatenate(hashes), return_inverse=True)
            flat, sizes = where[np.concatenate(stream)], np.concatenate(lengths)
            counts = np.bincount(flat[np.repeat(np.array(train, bool), sizes)], minlength=len(every))
            numbers = np.array([0 if i is None else i for i in ids], np.int64)
            data = _dump(numbers.view(_U), np.array([i is None for i in ids]), sizes, np.array(train, bool), np.diff(every, prepend=_U(0)), counts, flat)
            return _rows([[base + made, len(ids), sum(train), size, len(every), data]], BLOCK).to_batches()[0]

        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                words, found, counts = tokenized(batch.column(1))
                ends = np.cumsum(counts + 1) - 1
                part = np.zeros(len(found) + len(counts), np.int64)
                inside = np.ones(len(part), bool)
                inside[ends] = False
                part[inside] = found + np.int64(held)
                hashes.append(_hashes(words))
                held += len(words)
                stream.append(part)
                lengths.append(counts + 1)
                ids += batch.column(0).to_pylist()
                train += batch.column(2).to_pylist()
                size += len(part)
                if size >= tokens:
                    yield closed()
                    made += 1
                    hashes, stream, lengths, ids, train, held, size = [end], [], [], [], [], 1, 0
        if ids:
            yield closed()

    return docs.mapInArrow(run, BLOCK)


def _by_range(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted hashes begins, and the end."""
    bucket = (hashes >> _U(32)) * _U(buckets) >> _U(32)
    return np.searchsorted(bucket, np.arange(buckets + 1))


def ask_tokens(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns)):
                *_, hashes, counts, _ = _load(data)
                hashes = np.cumsum(hashes.astype(_U), dtype=_U)
                cuts = _by_range(hashes, buckets)
                rows = [[b, block, _dump(np.diff(hashes[i:j], prepend=_U(0)), counts[i:j])] for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
                yield from _rows(rows, ASK).to_batches()

    return blocks.select("block", "data").mapInArrow(run, ASK)


def answer_tokens(buckets: int):
    """A bucket's tokens: total counts, and numbers from 1 (frequent ones small); 0 where training has none."""

    def run(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        asked = [_load(x) for x in t.column("data").to_pylist()]
        hashes = [np.cumsum(x[0].astype(_U), dtype=_U) for x in asked]
        every, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, np.concatenate([x[1] for x in asked]), len(every)).astype(np.int64)
        seen = total > 0
        number = np.zeros(len(every), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(every)) * buckets + b + 1
        number[~seen] = 0
        if number.max() >= 1 << 32:
            raise ValueError("more than 2**32 different tokens: their numbers do not fit")
        stats = [float(seen.sum()), float(total.sum()), *[float((total == r).sum()) for r in range(1, K + 2)]]
        rows = [[TABLE, b, None, None, _dump(np.diff(every[seen], prepend=_U(0)), total[seen]), stats]]
        at = 0
        for block, h in zip(t.column("block").to_pylist(), hashes):
            k = where[at : at + len(h)]
            at += len(h)
            if block != STORED:
                rows.append([REPLY, b, block, None, _dump(number[k], total[k]), None])
        return _rows(rows, ANSWER)

    return run


class Discounts:
    """Good-Turing factors by count from counts of counts; where those give no factor
    between 0 and 1 (small corpora), half a count is taken off instead."""

    def __init__(self, n: list[float]) -> None:
        self.factor = np.ones(K + 2)
        tail = (K + 1) * n[K] / n[0] if n[0] else 1.0
        for r in range(1, K + 1):
            d = 0.0
            if n[r - 1] and tail < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
            self.factor[r] = d if 0 < d < 1 else (r - 0.5) / r
        self.freed = np.array([r - self.factor[r] * r for r in range(1, K + 1)])

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.factor[np.minimum(counts, K + 1)] * counts

    def sums(self, low: np.ndarray) -> np.ndarray:
        """Discounted counts, summed: ``low`` has how many are 1 to K, and the sum of the others."""
        return (self.factor[1 : K + 1] * np.arange(1, K + 1)) @ low[:K] + low[K]


class Unigrams:
    """P(token): discounted where known; what is left is the unknown token's."""

    def __init__(self, types: int, total: int, n: list[float]) -> None:
        self.types, self.total, self.discount = types, total, Discounts(n)
        left = float((self.discount.freed * n[:K]).sum())
        # without any count up to K nothing is freed: one event more is counted then
        self.scale, self.unknown = (total, left / total) if left else (total + 1, 1 / (total + 1))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discount(counts) / self.scale, self.unknown)


class _Level:
    """The distinct n-grams of one order in a block.

    ``place``: the n-gram that ends at each position; ``head`` and ``suffix``: its history and
    the n-gram without its first token, as places in the order below; ``count``: in training.
    ``few`` and ``low`` belong to the histories: followers with count 1 to K; and of the counts
    that the followers have without the history's first token, how many are 1 to K, and the
    sum of the larger ones (whole numbers travel better than what they are multiplied to).
    """

    def __init__(self, place, head, tail, suffix, own, below: int) -> None:
        self.place, self.head, self.tail, self.suffix, self.own = place, head, tail, suffix, own
        self.count = np.zeros(len(tail), np.int64)
        self.few, self.low = np.zeros((K, below), np.int32), np.zeros((K + 1, below), np.int64)


class _Block:
    """A block whose tokens have their numbers; orders are added one by one."""

    def __init__(self, values: list[np.ndarray], n_train: int, hot: int, buckets: int) -> None:
        ids, null, self.lengths, train, numbers, counts, stream = values
        self.doc_ids = [None if z else int(i) for i, z in zip(ids.view(np.int64), null)]
        self.train, self.hot, self.buckets = train.astype(bool), hot, buckets
        starts = np.cumsum(self.lengths) - self.lengths + np.arange(len(self.lengths))
        # the start mark is the first of the vocabulary, which goes by numbers; so places of n-grams go by what they spell
        self.stream = np.zeros(int(self.lengths.sum()) + len(starts), np.int32)
        inside = np.ones(len(self.stream), bool)
        inside[starts] = False
        self.stream[inside] = stream + 1
        self.depth = (np.arange(len(self.stream)) - np.repeat(starts, self.lengths + 1)).astype(np.int32)
        self.learned = np.repeat(self.train, self.lengths + 1)
        self.starts = starts
        self.numbers = np.append(0, np.cumsum(numbers))
        one = _Level(self.stream, None, np.arange(len(self.numbers)), None, None, 0)
        one.count = np.append(n_train, counts)
        self.levels = [None, one]

    def grow(self) -> int:
        """Adds the next order; returns it."""
        m, prior = len(self.levels), self.levels[-1].place
        j = np.flatnonzero(self.depth >= m - 1)
        head, tail = prior[j - 1], self.stream[j]
        where, first = _groups([head, tail])
        place = np.full(len(prior), -1, np.int32)
        place[j] = where
        own = np.bincount(where[self.learned[j]], minlength=len(first)).astype(np.int32)
        self.levels.append(_Level(place, head[first], tail[first], prior[j[first]], own, len(self.levels[-1].tail)))
        return m

    def spelled(self, m: int, which: np.ndarray) -> list[np.ndarray]:
        """The token numbers of n-grams of order ``m``, by column."""
        if m == 1:
            return [self.numbers[which]]
        level = self.levels[m]
        return [*self.spelled(m - 1, level.head[which]), self.numbers[level.tail[which]]]

    def parts(self, m: int, head: np.ndarray) -> np.ndarray:
        """Over how many buckets the followers of histories are dealt."""
        return np.maximum(1, -(-self.levels[m - 1].count[head] // self.hot))

    def entries(self, m: int, passes: int = 1, turn: int = 0):
        """What order ``m`` asks (in one turn), sorted by bucket, history and follower: n-grams (-1: none,
        a history alone), histories, followers, where a history's run begins, bounds of buckets."""
        level, below = self.levels[m], self.levels[m - 1].count
        some = below[level.head] > 0
        gram = np.flatnonzero(some & (below[level.suffix] > 0))
        head = level.head[gram]
        alone = np.zeros(len(below), bool)
        alone[level.head[some]] = True
        alone[head] = False
        alone = np.flatnonzero(alone)
        # n-grams lie by history and follower already (only tokens that training has, each with its own number, are left)
        at = np.searchsorted(head, alone)
        gram, head = np.insert(gram, at, -1), np.insert(head, at, alone)
        tail = self.numbers[level.tail[gram]]
        tail[gram < 0] = 0
        first = np.flatnonzero(_starts([head]))
        sizes = np.diff(np.append(first, len(head)))
        mixed = reduce(lambda x, c: _mix(x + c.astype(_U)), self.spelled(m - 1, head[first]), np.zeros(len(first), _U))
        parts = self.parts(m, head[first])
        bucket = np.repeat(self.bucket(mixed), sizes)
        if (parts > 1).any():
            split = np.flatnonzero(np.repeat(parts > 1, sizes))
            mixed, parts = (np.repeat(x, sizes)[split] for x in (mixed, parts))
            bucket[split] = self.bucket(_mix(mixed + _mix(tail[split].astype(_U)) % parts.astype(_U)))
        if passes > 1:
            now = np.flatnonzero((np.arange(self.buckets) % passes == turn)[bucket])
            gram, head, tail, bucket = (x[now] for x in (gram, head, tail, bucket))
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=self.buckets)))
        head = head[order]
        new = _starts([head])
        new[cuts[:-1][cuts[:-1] < cuts[1:]]] = True
        return gram[order], head, tail[order], np.flatnonzero(new), cuts

    def bucket(self, mixed: np.ndarray) -> np.ndarray:
        # in few bytes, which sort faster
        return ((mixed >> _U(16)) % _U(self.buckets)).astype(np.min_scalar_type(self.buckets))

    def asks(self, m: int, passes: int, turn: int) -> list[tuple[int, bytes]]:
        gram, head, tail, runs, cuts = self.entries(m, passes, turn)
        level = self.levels[m]
        own = np.where(gram >= 0, level.own[gram], 0)
        low = np.where(gram >= 0, self.levels[m - 1].count[level.suffix[gram]], 0)
        sizes = np.diff(np.append(runs, len(head)))
        columns, parts, at = self.spelled(m - 1, head[runs]), self.parts(m, head[runs]), np.searchsorted(runs, cuts)
        out = []
        for b in range(turn, self.buckets, passes):
            i, j, p, q = cuts[b], cuts[b + 1], at[b], at[b + 1]
            if i < j:
                out.append((b, _ask([c[p:q] for c in columns], sizes[p:q], tail[i:j], own[i:j], low[i:j], parts[p:q])))
        return out

    def hear(self, m: int, replies: dict[int, bytes], parts: dict[bytes, list[float]]) -> None:
        """Takes the answers to ``asks``: by bucket, and of hot histories by their numbers."""
        gram, head, _, runs, _ = self.entries(m)
        level, head = self.levels[m], head[runs]
        if replies:
            total, *sums = (np.concatenate(x) for x in zip(*[_load(replies[b]) for b in sorted(replies)]))
            some = gram >= 0
            level.count[gram[some]] = total[some]
            for row, x in zip((*level.few, *level.low), sums):
                row[head] = x
        hot = head[self.parts(m, head) > 1]
        for h, *key in zip(*(x.tolist() for x in (hot, *self.spelled(m - 1, hot)))):
            sums = parts[struct.pack(f"<{len(key)}I", *key)]
            level.few[:, h], level.low[:, h] = sums[:K], sums[K:]

    def probabilities(self, unigrams: Unigrams, discount: list) -> list:
        """P(last token | those before) of the distinct n-grams, order by order."""
        out, below = [None, unigrams(self.levels[1].count)], None
        for m in range(2, len(self.levels)):
            level, count = self.levels[m], self.levels[m - 1].count
            freed = discount[m].freed @ level.few
            # the denominators of the histories: their counts, and one event more where nothing is freed
            scale = count + (freed <= 0)
            left = np.where(freed > 0, freed, 1.0) / np.maximum(scale, 1)
            lows = (unigrams.discount if m == 2 else discount[m - 1]).sums(level.low)
            # the denominators of each history's own shorter history
            mass = lows / np.maximum(unigrams.scale if m == 2 else below[self.levels[m - 1].suffix], 1)
            weight = np.where(count > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
            out.append(np.where(level.count > 0, discount[m](level.count) / np.maximum(scale, 1)[level.head], weight[level.head] * out[-1][level.suffix]))
            below = scale
        return out

    def scores(self, unigrams: Unigrams, discount: list) -> pa.Table:
        top = len(self.levels) - 1
        log_p = np.zeros(len(self.stream))
        p = self.probabilities(unigrams, discount)
        for m in range(2, top):
            j = np.flatnonzero(self.depth == m - 1)
            log_p[j] = np.log10(p[m][self.levels[m].place[j]])
        j = np.flatnonzero(self.depth >= top - 1)
        log_p[j] = np.log10(p[top])[self.levels[top].place[j]]
        count = self.levels[1].count
        base, known = np.log10((count + 1) / (unigrams.total + unigrams.types + 1)), (count > 0).astype(np.int64)
        base[0], known[0] = 0.0, 0  # the start mark is no token
        add = lambda x: np.add.reduceat(x, self.starts).tolist()
        columns = [self.doc_ids, (~self.train).tolist(), self.lengths.tolist(), add(known[self.stream]), [unigrams.total] * len(self.lengths), add(base[self.stream]), add(log_p)]
        return _rows(list(zip(*columns)), SCORES)


def _ask(heads, sizes, tail, own, low, parts) -> bytes:
    """An ask's value: histories by column, their numbers of followers, these; a stored table has the same form."""
    return _dump(np.diff(heads[0], prepend=0), *heads[1:], sizes, tail, own, low, parts)


def answer_grams(m: int):
    """A bucket of order ``m``: adds up, makes its table, answers the blocks."""

    def run(t: pa.Table) -> pa.Table:
        b, blocks = t.column("bucket")[0].as_py(), t.column("block").to_pylist()
        asked = [_load(x) for x in t.column("data").to_pylist()]
        *columns, runs, tail, own, low, parts = (list(x) for x in zip(*asked))
        columns[0] = [np.cumsum(x) for x in columns[0]]
        heads = [len(x) for x in runs]
        grams = [len(x) for x in tail]
        columns = [np.concatenate(c) for c in columns]
        which, first = _groups(columns)
        tail, of = np.concatenate(tail), np.repeat(which, np.concatenate(runs))
        gram, one = _groups([of, tail])
        of, tail = of[one], tail[one]
        total = np.bincount(gram, np.concatenate(own), len(one)).astype(np.int64)
        low = np.concatenate(low)[one]
        seen, n = total > 0, len(first)

        def up_to_k(x):
            """How many followers of each history have 1 to K of ``x``."""
            at = np.flatnonzero(seen & (x > 0) & (x <= K))
            return np.bincount((x[at] - 1) * n + of[at], minlength=K * n).reshape(K, n)

        few, large = up_to_k(total), seen & (low > K)
        lows = np.vstack([up_to_k(low), np.bincount(of[large], low[large], n).astype(np.int64)])
        split = np.concatenate(parts)[first]
        spelled = [c[first] for c in columns]
        held = of[seen]
        at = np.flatnonzero(_starts([held])) if len(held) else np.zeros(0, np.int64)
        stats = [float((total == r).sum()) for r in range(1, K + 2)]
        sizes = np.diff(np.append(at, len(held)))
        rows = [[TABLE, b, None, None, _ask([c[held[at]] for c in spelled], sizes, tail[seen], total[seen], low[seen], split[held[at]]), stats]]
        hot = split > 1
        name = {h: struct.pack(f"<{m - 1}I", *(int(c[h]) for c in spelled)) for h in np.flatnonzero(hot).tolist()}
        rows += [[PART, b, None, key, None, [*few[:, h].astype(float).tolist(), *lows[:, h].astype(float).tolist()]] for h, key in name.items()]
        h0 = g0 = 0
        for block, n, k in zip(blocks, heads, grams):
            h, g = which[h0 : h0 + n], gram[g0 : g0 + k]
            h0, g0 = h0 + n, g0 + k
            if block != STORED:
                rows.append([REPLY, b, block, None, _dump(total[g], *few[:, h], *lows[:, h]), None])
                rows += [[WISH, b, block, name[x], None, None] for x in h[hot[h]].tolist()]
        return _rows(rows, ANSWER)

    return run


class Katz:
    """A fitted model: tables of n-gram counts by order, in buckets, and the sums over all of them."""

    def __init__(self, order: int = 3, block_tokens: int = 1_250_000, bucket_entries: int = 1_000_000, hot: int = 1_000_000, passes: int = 2) -> None:
        """``passes``: the buckets of an order above two are asked in so many turns, which divides what one shuffle holds."""
        if order < 2:
            raise ValueError("the order is 2 at least")
        self.order, self.block_tokens, self.bucket_entries, self.hot, self.passes = order, block_tokens, bucket_entries, hot, passes
        self.tables: list[tuple[int, int, DataFrame]] = []  # order, turn, table

    def fit(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Learn from ``docs`` (doc_id, text, train) where ``train`` is true; scores of all of them.

        Null text counts as empty: its end alone.  Without ``keep`` each table is
        deleted once all its n-grams have their answers.
        """
        return self._run(docs, True, keep)

    def score(self, docs: DataFrame) -> DataFrame:
        """Scores of any documents (doc_id, text) by the stored tables; ``held_out`` is true."""
        if not self.tables:
            raise ValueError("no tables: fit first, with keep")
        return self._run(docs.select("doc_id", "text", F.lit(False).alias("train")), False, True)

    def _run(self, docs: DataFrame, learn: bool, keep: bool) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("train").cast("boolean"), F.lit(False)).alias("train"))
        with Scratch(rows.sparkSession) as scratch:
            blocks = scratch.cut(make_blocks(rows, self.block_tokens), "katz-blocks")
            sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "tokens", "entries")]
            n_blocks, n_train, tokens, entries = blocks.agg(F.count(F.lit(1)), *sums).first()
            if learn:
                self.n_train = n_train
                self.token_buckets = max(16, -(-entries // self.bucket_entries))
                self.buckets = max(16, -(-tokens // self.bucket_entries))
                self.discount: list[Discounts | None] = [None, None]
            spread = max(1, n_blocks)
            # order one
            answers = self._answered(scratch, [ask_tokens(blocks, self.token_buckets)], 1, self.token_buckets, learn, keep, lambda: answer_tokens(self.token_buckets))
            numbered = scratch.cut_placed(self._numbered(blocks, answers[0], spread), "katz-numbered", "block", spread)
            scratch.drop(blocks)
            scratch.drop_parts(answers[0], f"kind={REPLY}")
            # the longer ones: each block is written again with what it has heard
            block, n_train, hot, buckets, order = numbered, self.n_train, self.hot, self.buckets, self.order
            for m in range(2, order + 1):
                passes = self.passes if m > 2 else 1
                asked = [self._asks(block, m, passes, turn) for turn in range(passes)]
                answers = self._answered(scratch, asked, m, buckets, learn, keep, lambda m=m: answer_grams(m))
                if m < order:
                    after = scratch.cut_placed(self._heard(block, answers, spread), f"katz-heard-{m}", "block", spread)
                    scratch.drop(block)
                    for a in answers:
                        scratch.drop_parts(a, *(f"kind={k}" for k in (REPLY, PART, WISH)))
                    block = after
            out = cut(self._scored(block, answers, spread), "katz-scores")
            if learn and keep:
                for a in answers:
                    scratch.drop_parts(a, *(f"kind={k}" for k in (REPLY, PART, WISH)))
                scratch.keep(*(t for _, _, t in self.tables))
            return out

    def _answered(self, scratch: Scratch, asked: list[DataFrame], m: int, buckets: int, learn: bool, keep: bool, answer) -> list[DataFrame]:
        """The written answers; learns the sums of order ``m``."""
        out, n = [], K + 3 if m == 1 else K + 1
        sums = np.zeros(n)
        for turn, ask in enumerate(asked):
            if not learn:
                stored = [t for order, k, t in self.tables if order == m and k == turn]
                ask = ask.unionByName(stored[0].where(f"kind = {TABLE}").select("bucket", F.lit(STORED).cast("long").alias("block"), "data"))
            made = scratch.cut(ask.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer(), ANSWER), f"katz-{m}", by="kind")
            out.append(made)
            if learn:
                sums += made.where(f"kind = {TABLE}").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0.0)) for k in range(n)]).first()
                if keep:
                    self.tables.append((m, turn, made))
                else:
                    scratch.drop_parts(made, f"kind={TABLE}")
        if learn and m == 1:
            self.unigrams = Unigrams(int(sums[0]), int(sums[1]), sums[2:].tolist())
        elif learn:
            self.discount.append(Discounts(sums.tolist()))
        return out

    def _numbered(self, blocks: DataFrame, answers: DataFrame, spread: int) -> DataFrame:
        """Blocks with numbers and counts in place of hashes."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _rows([], "block long, data binary")
            *head, _, _, stream = _load(left.column("data")[0].as_py())
            replies = sorted(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
            numbers, counts = (np.concatenate(x) for x in zip(*[_load(d) for _, d in replies]))
            # from here on the vocabulary goes in the order of its numbers
            order = np.argsort(numbers, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            return _rows([[left.column("block")[0].as_py(), _dump(*head, np.diff(numbers[order], prepend=0), counts[order], place[stream])]], "block long, data binary")

        replies = answers.where(f"kind = {REPLY}").select("block", "bucket", "data")
        left, right = (x.repartition(spread, "block").groupBy("block") for x in (blocks.select("block", "data"), replies))
        return left.cogroup(right).applyInArrow(run, "block long, data binary")

    def _opened(self):
        """(block's value) -> the block with all it has heard: orders follow each other in the value."""
        n_train, hot, buckets = self.n_train, self.hot, self.buckets

        def opened(data: bytes) -> _Block:
            values = _load(data)
            x = _Block(values[:7], n_train, hot, buckets)
            for at in range(7, len(values), 2 * K + 2):
                level = x.levels[x.grow()]
                level.count, *sums = values[at : at + 2 * K + 2]
                level.few, level.low = np.array(sums[:K], np.int32), np.array(sums[K:])
            return x

        return opened

    def _asks(self, block: DataFrame, m: int, passes: int, turn: int) -> DataFrame:
        opened = self._opened()

        def run(batches):
            for batch in batches:
                for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = opened(data)
                    x.grow()
                    yield from _rows([[b, number, ask] for b, ask in x.asks(m, passes, turn)], ASK).to_batches()

        return block.select("block", "data").mapInArrow(run, ASK)

    @staticmethod
    def _replies(answers: list[DataFrame]) -> DataFrame:
        """block, bucket, head, data, stats: the replies and the sums of hot histories."""
        every = reduce(DataFrame.unionByName, answers)
        replies = every.where(f"kind = {REPLY}").select("block", "bucket", "head", "data", "stats")
        total = every.where(f"kind = {PART}").groupBy("head").agg(F.array(*[F.sum(F.col("stats")[k]) for k in range(2 * K + 1)]).alias("stats"))
        wishes = every.where(f"kind = {WISH}").select("block", "head").distinct().join(total, "head")
        return replies.unionByName(wishes.select("block", F.lit(None).cast("int").alias("bucket"), "head", F.lit(None).cast("binary").alias("data"), "stats"))

    def _cogrouped(self, block: DataFrame, answers: list[DataFrame], spread: int, made, schema: str) -> DataFrame:
        opened = self._opened()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _rows([], schema)
            data = left.column("data")[0].as_py()
            x = opened(data)
            replies, parts = {}, {}
            for row in right.to_pylist():
                if row["bucket"] is None:
                    parts[row["head"]] = row["stats"]
                else:
                    replies[row["bucket"]] = row["data"]
            x.hear(x.grow(), replies, parts)
            return made(left.column("block")[0].as_py(), data, x)

        # the blocks lie in as many buckets already: only the replies move
        left, right = block.select("block", "data").groupBy("block"), self._replies(answers).repartition(spread, "block").groupBy("block")
        return left.cogroup(right).applyInArrow(run, schema)

    def _heard(self, block: DataFrame, answers: list[DataFrame], spread: int) -> DataFrame:
        def made(number: int, data: bytes, x: _Block) -> pa.Table:
            level = x.levels[-1]
            return _rows([[number, data + _dump(level.count, *level.few, *level.low)]], "block long, data binary")

        return self._cogrouped(block, answers, spread, made, "block long, data binary")

    def _scored(self, block: DataFrame, answers: list[DataFrame], spread: int) -> DataFrame:
        unigrams, discount = self.unigrams, self.discount
        return self._cogrouped(block, answers, spread, lambda number, data, x: x.scores(unigrams, discount), SCORES)


def score_corpus(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = 3) -> DataFrame:
    """Learn from the documents whose crc32(doc_id as text) mod ``modulus`` is not ``held``; score all.

    Null text counts as empty (its end alone); a null doc_id hashes as the empty
    text; repeated rows count and are scored each; an empty table gives an empty
    result; other columns are ignored.
    """
    return Katz(order).fit(docs.select("doc_id", "text", (crc_mod("doc_id", modulus) != held).alias("train")), keep=False)
