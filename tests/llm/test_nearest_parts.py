"""op6: parts of shards that queries pass by; nothing that grows with queries times shards meets on the driver."""

import numpy as np
import pytest

from ledgerframe.llm import ann


@pytest.fixture(scope="module")
def vectors(spark):
    """800 vectors of 12 and 90 of 3 components; some ids stand for two vectors."""
    rng = np.random.default_rng(21)
    data = [(i % 780, rng.normal(size=12).tolist()) for i in range(800)] + [(2000 + i, rng.normal(size=3).tolist()) for i in range(90)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)


def found(df, **more):
    return sorted(tuple(r) for r in ann.knn(df, df.where("vec_id % 5 = 0"), 5, shard_rows=40, **more).collect())


@pytest.mark.parametrize("tasks, held, block", [(1, 1 << 30, 1024), (4, 1 << 30, 16), (64, 1, 64)])
def test_parts_and_blocks_of_any_size_give_the_nearest(vectors, monkeypatch, tasks, held, block):
    """Shards of 40 vectors are searched whole, so the result is that of brute force."""
    data, df = vectors
    for name, value in (("TASKS", tasks), ("HELD", held), ("BLOCK", block)):
        monkeypatch.setattr(ann, name, value)
    best = {}
    for q, v in data:
        if q % 5 == 0:
            for i, w in data:
                if i != q and len(w) == len(v):
                    score = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
                    best.setdefault(q, {})[i] = max(score, best.get(q, {}).get(i, -2))
    right = [(q, n, i, s) for q in sorted(best) for n, (i, s) in enumerate(sorted(best[q].items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    got = found(df)
    assert [r[:3] for r in got] == [r[:3] for r in right]
    assert np.allclose([r[3] for r in got], [r[3] for r in right], rtol=0, atol=1e-12)


def test_no_side_of_the_search_is_broadcast(spark, vectors, monkeypatch):
    """Copies of the queries for the shards are made after the last exchange: Spark sees their size only when they are on the driver."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    old = store.executionsCount()
    found(vectors[1])
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(old, ran.size())]
    assert any("ann-nearest" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_a_task_holds_few_bytes_of_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "HELD", 1_000_000)
    index = spark.createDataFrame([(d, s, 100, 100, 28, 0) for d in (64, 256) for s in range(500)], "dim int, shard int, nodes int, rows int, degree int, start int")
    assert ann._together(index, 500) == 3  # of 318400 bytes each; 64 tasks alone would hold 8
    assert ann._together(index.where("dim = 64"), 500) == 8
    assert ann._together(index.where("dim = 64"), 30) == ann._together(index.limit(0), 1) == 1
