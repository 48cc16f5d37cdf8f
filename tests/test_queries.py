"""Every named query of the core against its SQL counterpart on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest

from tessera.plans.oracle import SQL
from tessera.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.select(*cols).toArrow().to_pylist())
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == cols
    assert got == collections.Counter(tuple(norm(r[c]) for c in cols) for r in want.to_pylist())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
