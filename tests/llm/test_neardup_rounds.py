"""Rounds of candidate pairs give the links that all pairs at once give."""

import os
from itertools import combinations

import numpy as np
import pytest

from ledgerframe.llm import neardup

DATA = "/root/testdata/sf0.01/documents.parquet"


def signed(low, weight):
    sig = np.zeros(len(low), neardup.SIG)
    sig["low"], sig["weight"] = low, weight
    return sig


def test_likeness_pairs_members_of_different_components_and_like_weight():
    rng = np.random.default_rng(3)
    low = rng.integers(0, 3, (300, neardup.SAMPLES))
    weight, root = rng.uniform(5, 9, 300).astype(np.float32), rng.integers(0, 4, 300)
    i, j, like = neardup.likeness(signed(low, weight), root, 0.8)
    found = dict(zip(zip(i.tolist(), j.tolist()), like.tolist()))
    wanted = {(a, b): int((low[a] == low[b]).sum()) for b, a in combinations(range(300), 2) if root[a] != root[b] and min(weight[a], weight[b]) >= 0.8 * 0.9999 * max(weight[a], weight[b])}
    assert found == wanted and wanted


def test_forest_spans_the_components_with_the_likest_pairs():
    like = np.array([9, 8, 7, 6, 5])
    i, j = np.array([1, 2, 2, 3, 4]), np.array([0, 1, 0, 2, 3])
    assert neardup.forest(i, j, like, np.arange(5)).tolist() == [0, 1, 3, 4]
    assert neardup.forest(i, j, like, np.array([0, 1, 1, 2, 2])).tolist() == [0, 3]


def test_first_places():
    i, j, like = np.array([3, 3, 3, 2, 2]), np.array([0, 1, 2, 0, 1]), np.array([5, 9, 9, 1, 2])
    chosen, more = neardup.first_places(i, j, like, 2)
    assert sorted(chosen.tolist()) == [1, 2, 3, 4] and more
    assert not neardup.first_places(i, j, like, 3)[1]


def test_cells_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    texts = []
    for size in (3, 60, 150, 400, 3000, 9000):
        h = rng.integers(0, 1 << 63, size, np.uint64)
        for changed in (0, 1, 0.05, 0.1, 0.2, 0.4):
            n = int(changed if changed == 1 else changed * size)
            g = h.copy()
            g[:n] = rng.integers(0, 1 << 63, n, np.uint64)
            texts.append((np.sort(g), rng.integers(1, 3, size) * rng.uniform(1, 1.25, size)))
    weight = np.array([w.sum() for _, w in texts], np.float32)
    held = [neardup.cells(h, w) for h, w in texts]
    i, j = map(np.array, zip(*[(a, b) for b, a in combinations(range(len(texts)), 2)]))
    kept = neardup.within_bound(i, j, weight, held, 0.8)

    def similarity(a, b):
        (h, w), (g, v) = texts[a], texts[b]
        _, x, y = np.intersect1d(h, g, assume_unique=True, return_indices=True)
        shared = np.minimum(w[x], v[y]).sum()
        return shared / (w.sum() + v.sum() - shared)

    near = np.array([similarity(a, b) >= 0.8 for a, b in zip(i, j)])
    assert near.any() and kept[near].all() and (~kept).sum() > 100


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_classes_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    texts = [r.text for r in spark.read.parquet(DATA).select("text").collect()]
    for text in [t for t in texts if t and len(t.split()) > 40][:150]:
        for share in rng.uniform(0.002, 0.06, 3):  # of the words: from nearly equal to well below the threshold
            words = text.split()
            for at in rng.integers(0, len(words), max(1, int(share * len(words)))):
                words[at] = f"edit{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = docs.collect()
    rare = neardup.rarity(docs)
    bags = []
    for r in rows:
        h, c = neardup.shingles(r.text)
        bags.append(dict(zip(h.tolist(), neardup.weights(h, c, rare).tolist())))
    first: dict = {}
    same = [first.setdefault(r.text or "", k) for k, r in enumerate(rows)]
    holders: dict = {}
    for k, bag in enumerate(bags):
        if same[k] == k:
            for h in bag:
                holders.setdefault(h, []).append(k)
    pairs = {p for held in holders.values() for p in combinations(held, 2)}
    links = []
    for a, b in pairs:
        if min(len(bags[a]), len(bags[b])):
            shared = sum(min(w, bags[b].get(h, 0)) for h, w in bags[a].items())
            if shared >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                links.append((a, b))
    top = list(same)

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[max(root(a), root(b))] = min(root(a), root(b))
    wanted: dict = {}
    for k, r in enumerate(rows):
        wanted.setdefault(root(k), []).append(r.doc_id)
    wanted = {d: min(members) for members in wanted.values() for d in members}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).select("doc_id", "class_id").collect()}
    linked = [got[rows[a].doc_id] == got[rows[b].doc_id] for a, b in links]
    print(len(links), np.mean(linked))
    assert len(links) > 150 and np.mean(linked) >= 0.99
    # no class holds what no link joins
    assert all(wanted[d] == wanted[c] for d, c in got.items())


def test_samples_of_large_and_small_weights_agree_by_similarity():
    rng, s = np.random.default_rng(2), neardup.Sampler()
    for low, high in ((0.1, 1), (1, 1.25), (0.5, 9)):
        h, other = rng.integers(0, 1 << 63, (2, 300), np.uint64)
        a, b = rng.uniform(low, high, (2, 300))
        other[60:] = h[60:]
        shared = np.minimum(a, b)[60:].sum()
        true = shared / (a.sum() + b.sum() - shared)
        flips = rng.integers(0, 1 << 63, 30, np.uint64)
        hits = [(s.samples(h ^ f, a) == s.samples(other ^ f, b)).mean() for f in flips]
        assert abs(np.mean(hits) - true) < 0.03


def test_occurrences_count_documents_once(spark):
    text = " ".join(["a b c d e f"] * 40)
    h, c = neardup.shingles(text)
    assert len(h) == 6 and c.sum() == len(neardup.occurrences(text)) == 236
    rare = neardup.rarity(spark.createDataFrame([(k, text if k < 5 else f"w{k} x y z v") for k in range(2000)], "doc_id long, text string"))
    at = (h & np.uint64(neardup.COUNTERS - 1)).astype(np.int64)
    assert len(set(rare[at].tolist())) == 1 and rare[at][0] > 200


def test_candidates_name_the_parts_that_hold_more(spark):
    """Only these are looked at again."""
    rng = np.random.default_rng(1)
    low = rng.integers(0, 3, (43, neardup.SAMPLES))
    sig = signed(low, np.full(43, 9, np.float32))
    rows = [(1 if k < 40 else 2, k % 2 if k < 40 else 0, bytes([k]) * 16, sig[k].tobytes(), bytes([k]) * 16, b"\x02" * 256, 1.0) for k in range(43)]
    members = spark.createDataFrame(rows, "bucket long, part long, key binary, sig binary, root binary, cells binary, step float")
    got = neardup.candidates(members, 0.8, 16).collect()
    assert {(r.bucket, r.part) for r in got if r.a is None} == {(1, 0), (1, 1)}
    assert len([r for r in got if r.a is not None]) == 3 + 2 * sum(min(k, 16) for k in range(20))
