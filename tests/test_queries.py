"""Every query against its SQL in DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

from fieldsheet.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.SQL:
        assert rows
        return
    cur = db.execute(registry.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, rows), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_the_entry_knows_the_other_package():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "fieldsheet"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import)[ .\w]*\bllm\b", p.read_text()), p
