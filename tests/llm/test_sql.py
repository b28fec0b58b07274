"""Queries that SQL can express, against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pytest

from fieldsheet.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
