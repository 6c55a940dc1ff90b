from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(_plain(x) for x in v) if isinstance(v, list | tuple) else v


def compare(spark, name, fn, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = fn(spark, sf)
    names = sorted(got.columns)
    a = sorted(repr(tuple(_plain(r[c]) for c in names)) for r in got.collect())
    want = con.sql(sql)
    assert sorted(want.columns) == names
    b = sorted(repr(tuple(map(_plain, r))) for r in want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
    assert a == b, name


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 1


def test_contract(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
