"""Every drawing query against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from planframe import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    return sorted((tuple(repr(plain(r[c])) for c in columns) for r in rows))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert rows_of(columns, [r.asDict() for r in got.collect()]) == rows_of(columns, want)


def test_without_sql_there_are_rows(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, DATA).columns
