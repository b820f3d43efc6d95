"""Every registered query against its DuckDB twin on the smallest driver tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from tickwise.plans.registry import QUERIES
from tools.oracle_check import TABLES, canon

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(E.oracle_sql())
    assert missing == set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["ticker", "as_of_date"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = canon([tuple(r) for r in df.collect()], cols)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [x[0] for x in cur.description]
    want = canon(cur.fetchall(), ocols)
    assert sorted(cols) == sorted(ocols)
    assert got == want


@pytest.mark.parametrize("name", ["ratio_panel", "parse_iso_date", "data_summary",
                                  "candlestick_data"])
def test_results_independent_of_session_timezone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = E.queries()[name](spark, SF)
        got = canon([tuple(r) for r in df.collect()], df.columns)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    cur = con.execute(E.oracle_sql()[name])
    assert got == canon(cur.fetchall(), [x[0] for x in cur.description])
