"""Every query against its own SQL, run by another engine over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loamstack.plans.all import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: No SQL, as a model or a digest of Spark's own JSON is in them; other tests hold these.
WITHOUT_SQL = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{DATA}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    yield con
    con.close()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.5f}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, other, name):
    got = QUERIES[name](spark, DATA)
    want = other.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(([plain(r[c]) for c in order] for r in got.collect()), key=str)
    told = sorted(([plain(v) for _, v in sorted(zip(names, r, strict=True))] for r in want.fetchall()), key=str)
    assert rows == told


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_runs(spark, name):
    got = QUERIES[name](spark, DATA)
    assert got.columns and got.count() >= 0


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns
