"""Links that repeated shingles make or hide are found."""

import numpy as np

from ledgerframe.llm import neardup


def classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).select("doc_id", "class_id").collect()}


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_weight_in_repeated_lines(spark):
    line = f" {words('line', 12)} " * 2000
    assert classes(spark, [words("a", 500) + line, words("b", 500) + line, words("c", 500)]) == {0: 0, 1: 0, 2: 2}


def test_alike_as_sets_only(spark):
    """The weighted similarity alone decides: the same set of shingles with other counts is no link."""
    text = words("w", 150)
    once = " ".join([text, words("x", 20)])
    again = " ".join([text] + [words("y", 12)] * 100)
    h, c = neardup.shingles(once)
    g, d = neardup.shingles(again)
    shared = len(np.intersect1d(h, g))
    assert shared / (len(h) + len(g) - shared) >= 0.8 and shared / (c.sum() + d.sum() - shared) < 0.2
    assert classes(spark, [once, again, words("z", 150)]) == {0: 0, 1: 1, 2: 2}


def test_large_buckets_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    chain, texts = [f"t{k}" for k in range(150)], []
    for step in range(24):  # only neighbours in the chain are near
        texts.append(" ".join(chain))
        for at in (6 * step, 6 * step + 3):
            chain[at] = f"e{step}x{at}"
    texts += [" ".join([*map(str, range(150)), f"end{k}"]) for k in range(60)]
    docs = spark.createDataFrame([(int(k), texts[k]) for k in rng.permutation(len(texts))], "doc_id long, text string")
    most, candidates = [], neardup.candidates

    def seen(members, *rest):
        most.append(members.groupBy(*[c for c in ("bucket", "part") if c in members.columns]).count().agg({"count": "max"}).first()[0])
        return candidates(members, *rest)

    monkeypatch.setattr(neardup, "candidates", seen)
    monkeypatch.setattr(neardup, "LARGE", 8, raising=False)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).select("doc_id", "class_id").collect()}
    assert got == {k: 0 if k < 24 else 24 for k in range(len(texts))}
    assert max(most) < 40  # two cells of about 8, and chance
