"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, data, duck, name):
    got = entry.queries()[name](spark, data)
    cols = sorted(got.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
