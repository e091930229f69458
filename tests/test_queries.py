"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ledgerframe import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_sql():
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [r.asDict() for r in df.collect()]
    asked = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r)) for r in asked.fetchall()]
    floats = {c for c in columns if any(isinstance(r[c], float) for r in [*got, *want])}
    order = [c for c in columns if c not in floats] + sorted(floats)

    def ordered(rows):
        return sorted(rows, key=lambda r: [(r[c] is not None, r[c] or 0.0) if c in floats else plain(r[c]) for c in order])

    assert len(got) == len(want)
    for x, y in zip(ordered(got), ordered(want)):
        assert [plain(x[c]) for c in order if c not in floats] == [plain(y[c]) for c in order if c not in floats]
        for c in floats:
            # a mean that lies between two roundings may fall on either side
            assert x[c] == y[c] or x[c] == pytest.approx(y[c], rel=1e-9, abs=1.1e-6)
