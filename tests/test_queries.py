"""Every query that has SQL equals DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from artefold.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    return con


def _text(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(_text, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    want = Counter(tuple(_text(r[i]) for i in at) for r in cur.fetchall())
    got = Counter(tuple(_text(v) for v in r) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    """Queries without SQL run over the whole tables and have unlike column names."""
    df = QUERIES[name](spark, small)
    df.collect()
    assert len(set(df.columns)) == len(df.columns)


def test_names_are_unique_and_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_registering(spark):
    registry.register("own_query", lambda s, d: s.range(3))
    try:
        assert registry.queries()["own_query"](spark, "").count() == 3
        with pytest.raises(ValueError):
            registry.register("own_query", None)
    finally:
        registry.ADDED.clear()
