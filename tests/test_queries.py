"""Registered queries against their SQL; FLUXLOOM_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ("a1_", "a2_", "a5_", "b3_", "b11_", "c1_", "c3_cross_match_status", "c7_", "d1_", "d7_", "e4_", "f1_", "g2_", "h5_", "h21_", "i1_", "j6_", "j12_", "k1_")
NAMES = [n for n in oracle_sql() if os.environ.get("FLUXLOOM_ALL") or n.startswith(QUICK)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    res = duck.execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
