"""Rounds of the ancestor search: narrow ones move neither the parents nor what was met."""

import pytest

from ledgerframe.operators import snapshot


@pytest.fixture
def parents(spark):
    return spark.createDataFrame([(k, p) for k in range(1, 400) for p in {k // 2, k // 3}], "id long, parent long")


def least(start):
    met, frontier, distance = {start: 0}, [start], 0
    while frontier:
        distance += 1
        frontier = {p for k in frontier if k for p in (k // 2, k // 3)} - met.keys()
        met |= dict.fromkeys(frontier, distance)
    return met


def test_narrow_rounds_move_no_large_table(spark, parents, monkeypatch):
    plans, saved = [], snapshot.saved

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(snapshot, "saved", seen)
    assert dict((r.id, r.distance) for r in snapshot.ancestors(parents, [399], "long").collect()) == least(399)
    assert [r.id for r in snapshot.merge_bases(parents, 399, 392, "long").collect()] == [14, 49]
    assert plans and not [p for p in plans[:-1] if "SortMergeJoin" in p or "ShuffledHashJoin" in p]


@pytest.mark.parametrize("narrow", [0, 3])
def test_wide_rounds_give_the_same(spark, parents, monkeypatch, narrow):
    monkeypatch.setattr(snapshot, "NARROW", narrow)
    got = snapshot.ancestors(parents, [399, 392], "long").collect()
    assert sorted((r.start, r.id, r.distance) for r in got) == sorted((s, k, d) for s in (399, 392) for k, d in least(s).items())
