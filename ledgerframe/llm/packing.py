"""Operator 5: best-fit packing of token pieces, improved by a swap-based local search.

Pieces are dealt at random into groups of bounded size.  Each group is packed by
itself: best fit, longest first; then a local search moves pieces between bins that
are not full, one for one, two for one, or a piece alone, whenever that raises the
sum of squared fills, until bins run empty or no exchange helps.  The bins that a
group leaves well below full are opened again and packed together in later rounds,
so the groups cost next to nothing in fill.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, cut, sliced
from .words import library_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect.bisect_left(spaces, lengths[i])
        if at < len(spaces):
            space = spaces[at]
            b = by_space[space].pop()
            if not by_space[space]:
                del by_space[space], spaces[at]
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if rest := space - lengths[i]:
            if rest not in by_space:
                bisect.insort(spaces, rest)
                by_space[rest] = []
            by_space[rest].append(b)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the bins that are not full.

    A sweep takes each underfull bin as giver, the emptiest first.  For each other one,
    fullest first, it makes the exchange that fills it most: a piece moved, one for one,
    two of the giver's for one, or one for two.  Each raises the sum of squared fills
    (what a bin at least as full gains, the giver loses), so the sweeps end: at the lower
    bound, or when a whole sweep finds nothing.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    live = {k for k in range(len(bins)) if bins[k]}
    gained = True
    while gained and len(live) > least:
        gained = False
        for giver in sorted((k for k in live if fill[k] < capacity), key=lambda k: (fill[k], k)):
            for t in sorted((k for k in live if k != giver and fill[giver] <= fill[k] < capacity), key=lambda k: (-fill[k], k)):
                while fill[giver] <= fill[t] < capacity and (step := _exchange(bins[giver], bins[t], lengths, capacity - fill[t])) is not None:
                    out, back = step
                    for i in out:
                        bins[giver].remove(i)
                    for i in back:
                        bins[t].remove(i)
                    bins[giver] += back
                    bins[t] += out
                    moved = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                    fill[t] += moved
                    fill[giver] -= moved
                    gained = True
                    if not bins[giver]:
                        break
                if not bins[giver]:
                    live.discard(giver)
                    break
            if len(live) <= least:
                break
    return [b for b in bins if b]


def _by_length(pieces: list[int], lengths: list[int]) -> tuple[list[tuple[int, tuple[int, ...]]], list[tuple[int, tuple[int, ...]]]]:
    """(one piece, two pieces) for each different length, sorted by it: pieces of one length are alike,
    and a bin has few lengths (their sum is at most its capacity)."""
    same: dict[int, list[int]] = {}
    for i in sorted(pieces):
        same.setdefault(lengths[i], []).append(i)
    sizes = sorted(same)
    pairs: dict[int, tuple[int, ...]] = {}
    for a, x in enumerate(sizes):
        for y in sizes[a:]:
            if x != y:
                pairs.setdefault(x + y, (same[x][0], same[y][0]))
            elif len(same[x]) > 1:
                pairs.setdefault(2 * x, (same[x][0], same[x][1]))
    return [(x, (same[x][0],)) for x in sizes], sorted(pairs.items())


def _exchange(giver: list[int], taker: list[int], lengths: list[int], space: int) -> tuple[list[int], list[int]] | None:
    """The exchange with the largest gain of at most ``space``, or None."""
    best, found = 0, None
    mine, two = _by_length(giver, lengths)
    theirs, both = _by_length(taker, lengths)
    for backs, outs in (([(0, ()), *theirs], (mine, two)), (both, (mine,))):
        for size, back in backs:
            for out in outs:
                at = bisect.bisect_right(out, size + space, key=lambda x: x[0]) - 1
                if at >= 0 and out[at][0] - size > best:
                    best, found = out[at][0] - size, (list(out[at][1]), list(back))
                    if best == space:
                        return found
    return found


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices for one group."""
    return improve(best_fit(lengths, capacity), lengths, capacity)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's ids and end id, cut only where longer than ``capacity``."""

    def run(batches):
        encoder, end = library_encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int, group_rows: int = 8192, open_below: float = 0.98) -> DataFrame:
    """``pieces`` (a written table with ``length``, at most ``capacity`` each) with sequence_id and offset.

    Rounds go on until what is open fits one group, or a round closes less than a tenth of
    it.  Every row is placed once, rows that repeat too (groups are chosen by the row's
    number in its task as well); a row of length null or 0 takes no room.
    """
    with Scratch(pieces.sparkSession) as scratch:
        names = list(pieces.columns)
        todo, done, before, k = pieces, None, None, 0
        n = todo.count()
        while True:
            groups = max(1, -(-n // group_rows))
            last = groups == 1 or (before is not None and 10 * n > 9 * before)

            def run(t: pa.Table) -> pa.Table:
                lengths = [x or 0 for x in t.column("length").to_pylist()]
                group = t.column("_group")[0].as_py()
                number, offset, closed = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(len(lengths), bool)
                for b, rows in enumerate(pack_lengths(lengths, capacity)):
                    at = 0
                    for i in rows:
                        number[i], offset[i] = (k << 56) + (group << 24) + b, at
                        at += lengths[i]
                    closed[rows] = last or at >= open_below * capacity
                t = t.drop_columns(["_group"])
                for name, column in (("sequence_id", number), ("offset", offset), ("_closed", closed)):
                    t = t.append_column(name, pa.array(column))
                return t

            group = F.pmod(F.xxhash64(*names, F.monotonically_increasing_id(), F.lit(k)), F.lit(groups)).cast("int")
            dealt = todo.select(*names, group.alias("_group"))
            schema = dealt.drop("_group").schema.add("sequence_id", "long").add("offset", "long").add("_closed", "boolean")
            packed = scratch.cut(dealt.repartition(groups, "_group").groupBy("_group").applyInArrow(run, schema), "packed")
            part = packed.where("_closed").drop("_closed")
            done = part if done is None else done.unionByName(part)
            if last:
                return cut(done, "packed")
            todo, before, k = packed.where("not _closed").select(*names), n, k + 1
            n = todo.count()
            if not n:
                return cut(done, "packed")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of all whole texts with their sequences; the texts are encoded once.

    Null text counts as empty (its end id alone); null and repeated doc_ids keep
    their rows apart; an empty table gives an empty result; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        return pack_pieces(scratch.cut(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
