"""Queries against their SQL in DuckDB at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_query_without_oracle(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
