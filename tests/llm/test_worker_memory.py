"""What a Python worker holds: one operator's words at a time, slices of batches, blocks of pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerframe.llm import neardup, words
from ledgerframe.llm.common import sliced


def test_a_worker_holds_the_words_of_one_operator():
    before = [neardup.shingles(t)[0].tolist() for t in ("one two three four five six", "uno dos tres")]
    assert len(neardup._MEMO) >= 9
    pieces = words.Memo(len, 4)
    assert [pieces[p] for p in ("a", "bb", "a", "ccc", "dddd", "eeeee")] == [1, 2, 1, 3, 4, 5]
    assert not neardup._MEMO and not neardup._MEMO.old
    # what is learned again is the same, and the other memo goes in turn
    assert [neardup.shingles(t)[0].tolist() for t in ("one two three four five six", "uno dos tres")] == before
    assert not pieces and not pieces.old


@pytest.mark.parametrize("most", [1, 1000, 1 << 30])
def test_slices_are_the_whole_batch_in_order(most):
    texts = ["x" * 5000, None, "", *(f"text {i}" * (i % 40) for i in range(300))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(sliced(iter([batch, batch.slice(0, 0), batch]), most))
    assert pa.Table.from_batches(found) == pa.Table.from_batches([batch, batch])
    assert all(b.num_rows == 1 or b.nbytes <= 6000 + most for b in found)
    assert [b.num_rows for b in found].count(0) == 1  # an empty batch stays one
    assert len(found) == 3 or most < 1 << 30


def test_a_large_part_is_compared_in_small_blocks():
    sig = np.zeros(2 * neardup.LARGE, neardup.SIG)
    sig["low"] = np.random.default_rng(3).integers(0, 2, (len(sig), neardup.SAMPLES))
    sig["weight"] = 1
    root = np.arange(len(sig))
    tracemalloc.start()
    i, j, like = neardup.likeness(sig, root, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == len(sig) * (len(sig) - 1) // 2
    assert all((a == b).all() for a, b in zip((i, j, like), neardup.likeness(sig, root, 0.8, 128)))
    print(most)
    assert most < 40 << 20
