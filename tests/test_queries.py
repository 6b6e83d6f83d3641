"""Every registered timeline query against its SQL in DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import queries as timeline

SF = "/root/testdata/sf0.001"
SQL = timeline.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(timeline.queries()))
def test_query(spark, duck, name):
    df = timeline.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    r = duck.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
