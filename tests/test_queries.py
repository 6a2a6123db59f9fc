"""Every query against its SQL, on the smallest tables that give it rows."""

import math

import duckdb
import pytest

from wordloom import queries
from wordloom.plans import pages, words

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
#: Queries that keep nothing of the smallest tables.
LARGER = {*words.QUERIES, *pages.QUERIES}


@pytest.fixture(scope="module")
def sql():
    found = {}
    for sf in (SF, SF.replace("0.001", "0.01")):
        found[sf] = duckdb.connect()
        for t in TABLES:
            found[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return found


def place(name):
    return SF.replace("0.001", "0.01") if name in LARGER else SF


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def table(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, place(name))
    expected = sql[place(name)].sql(queries.ORACLES[name])
    got = table(df.columns, df.collect())
    assert got == table(expected.columns, expected.fetchall())
    assert got[1]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_rows_only(spark, name):
    """What SQL can't express gives rows here; tests/test_whole.py compares it with plain versions."""
    assert queries.QUERIES[name](spark, place(name)).count() > 0


def test_rollup_of_nothing(spark):
    empty = spark.createDataFrame([], "book string, level int")
    assert [tuple(r) for r in words.rolled_up(empty).collect()] == [(None, None, 0)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
