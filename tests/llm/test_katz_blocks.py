"""Blocks of the Katz model: their orders come without sorting n-grams once more, and their values are narrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ledgerframe.llm.katz")

from ledgerframe.llm import katz  # noqa: E402

NUMBERS = [3, 7, 70_000, 0, 5_000_000, 12]  # 0: training does not have that token


def block(hot=1_000_000, buckets=5):
    """Four documents, the last one held out; counts are those of the stream's first three."""
    rng = np.random.default_rng(1)
    lengths = np.array([40, 1, 300, 60])
    numbers = np.sort(NUMBERS)
    stream = rng.integers(1, 6, lengths.sum())
    stream[341:] = rng.integers(0, 6, 60)
    counts = np.bincount(stream[:341], minlength=6)
    values = [np.arange(4).astype(np.uint64), np.zeros(4, np.int64), lengths, np.array([1, 1, 1, 0]), np.diff(numbers, prepend=0), counts, stream]
    return katz._Block(values, 3, hot, buckets), [numbers[s].tolist() for s in np.split(stream, np.cumsum(lengths)[:-1])]


def grams(documents, m):
    return {tuple(w[k : k + m]) for w in ([-1, *d] for d in documents) for k in range(len(w) - m + 1)}


@pytest.mark.parametrize("hot, passes", [(1_000_000, 1), (20, 1), (20, 2)])
def test_entries_need_no_sort_of_n_grams(monkeypatch, hot, passes):
    x, documents = block(hot)
    seen = set(NUMBERS) - {0}
    for m in (2, 3):
        x.grow()
        level = x.levels[m]
        spelled = list(zip(*(c.tolist() for c in x.spelled(m, np.arange(len(level.tail))))))
        assert set(spelled) == {tuple(max(0, c) for c in g) for g in grams(documents, m)}
        wanted = {g for g in spelled if all(c in seen for c in g[1:]) and (g[0] in seen or g[0] == 0)}
        found = []
        with monkeypatch.context() as patched:
            patched.setattr(katz, "_order", None)
            for turn in range(passes):
                gram, head, tail, runs, cuts = x.entries(m, passes, turn)
                heads = list(zip(*(c.tolist() for c in x.spelled(m - 1, head))))
                for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    rows = [(*h, t) for h, t in zip(heads[i:j], tail[i:j].tolist())]
                    assert rows == sorted(rows) and (not rows or b % passes == turn)
                    new = [k for k in range(i, j) if k == i or heads[k] != heads[k - 1]]
                    assert new == runs[(runs >= i) & (runs < j)].tolist()
                found += [((*h, t), g) for h, t, g in zip(heads, tail.tolist(), gram.tolist())]
        asked = {g: at for g, at in found if at >= 0}
        known = {g: k for k, g in enumerate(spelled)} if m == 2 else asked
        assert len(asked) == sum(at >= 0 for _, at in found)
        assert {g for g in wanted if 0 not in g[:1]} <= set(asked)
        assert all(spelled[at] == g and known[g] == at for g, at in asked.items() if g[0])
        level.count = level.own.astype(np.int64)  # one block alone: its counts are all there are


def test_values_hold_no_more_bytes_than_their_numbers_need():
    numbers = np.random.default_rng(0).integers(0, 1 << 24, 100_000)
    data = katz._dump(numbers)
    assert len(data) < 3.01 * len(numbers)
    # a byte of zeros costs nothing: the planes are counted, not their compressed size
    assert data[0] == 3
    wide = [np.array([], np.int64), np.array([0]), np.array([True, False]), *[np.array([0, (1 << 8 * k) - 1, 1 << 8 * (k - 1)], np.uint64) for k in range(1, 9)]]
    for x, back in zip(wide, katz._load(katz._dump(*wide)), strict=True):
        assert back.tolist() == x.tolist()


def test_blocks_of_many_slices_know_each_word_once(monkeypatch):
    """Slices of two rows share a vocabulary; the end is one word in it; an empty text is its end alone."""

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 2

    monkeypatch.setattr(katz, "TaskContext", Context)
    texts = ["b a", "A c", " a\tb ", "", "c c d", None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array([5, None, -1, 3, 4, 6, 7], pa.int64()), pa.array([t or "" for t in texts]), pa.array([True] * 6 + [False])], ["doc_id", "text", "train"])
    (made,) = katz.make_blocks(Docs(), 1000, rows=2)([batch])
    ids, null, sizes, train, hashes, counts, stream = katz._load(made.column("data")[0].as_py())
    words = {w: int(h) for w, h in zip(["a", "b", "c", "d", "é", " end"], katz._hashes(pa.array(["a", "b", "c", "d", "é", " end"])))}
    every = np.cumsum(hashes.astype(np.uint64), dtype=np.uint64)
    place = {w: every.tolist().index(h) for w, h in words.items()}
    flat = [place[w] for t in texts for w in [*(t or "").lower().split(), " end"]]
    assert stream.tolist() == flat and sizes.tolist() == [3, 3, 3, 1, 4, 1, 2]
    assert [int(counts[place[w]]) for w in ("a", "b", "c", "d", "é", " end")] == [3, 2, 3, 1, 0, 6]
    assert ids.view(np.int64).tolist() == [5, 0, -1, 3, 4, 6, 7] and null.tolist() == [0, 1, 0, 0, 0, 0, 0]
    assert made.column("block")[0].as_py() == 2 << 24
    (empty,) = katz.make_blocks(Docs(), 1000)([batch.slice(3, 1)])
    *_, hashes, _, stream = katz._load(empty.column("data")[0].as_py())
    assert np.cumsum(hashes.astype(np.uint64), dtype=np.uint64)[stream].tolist() == [words[" end"]]
