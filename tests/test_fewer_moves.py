"""Rows are moved and written no more often than needed: the bridge by ticker, and the sinks' rewrites."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickwise.sources.bridge import Bridge
from tickwise.sources.store import Store

DAY = dt.datetime(1995, 1, 3)


@pytest.fixture
def tables(spark, tmp_path):
    """Lines with a repeated part, a part without lines, null keys and lines of one day."""
    lines = [(o, p, s, n, 2.0, 10.0 * o + n, 0.05, 0.01, DAY + dt.timedelta(days=o % 3), "RAN"[o % 3], "FO"[n % 2])
             for o in range(1, 9) for n, (p, s) in enumerate([(1, 1), (2, 1), (3, None), (None, 2)], 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp, l_returnflag string, "
                          "l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, "Brand#11", 3, 9.5), (1, "Brand#11", 3, 9.5), (2, "Brand#12", 4, 8.5), (3, None, 5, 7.5), (9, "Brand#13", 6, 6.5)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int, p_retailprice double").write.parquet(
        f"{tmp_path}/part.parquet")
    return str(tmp_path)


def _rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("density", ["dense", "medium", "sparse"])
def test_rows_by_ticker_give_the_same_tables_without_an_exchange(spark, tables, density):
    plain, moved = Bridge(spark, tables, density), Bridge(spark, tables, density).by_ticker()
    for make in (Bridge.prices, Bridge.fundamentals):
        got = make(moved)
        assert _rows(got) == _rows(make(plain)) and got.count()
        assert "Exchange" not in make(moved)._jdf.queryExecution().executedPlan().toString()
    assert _rows(Bridge(spark, tables, density).by_ticker(False).prices()) == _rows(plain.prices())


def _prices(spark, days, close=1.0):
    return spark.range(days).select(
        F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("ticker"),
        F.date_add(F.lit("1995-12-30").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(close).alias("close"))


def test_a_rewrite_stages_the_batch_only(spark, tmp_path, monkeypatch):
    """Neither the rows that stay nor the keys of an upsert are written a second time."""
    st = Store(spark, str(tmp_path / "s"), buckets=2)
    st.write_prices(_prices(spark, 6))
    staged = []
    plain = Store._staged
    monkeypatch.setattr(Store, "_staged", lambda self, df: staged.append(df.columns) or plain(self, df))
    st.append_prices(_prices(spark, 2, 2.0).where("ticker <> 'C'"))
    assert len(staged) == 1
    assert sorted(r.close for r in st.scan_prices().collect()) == [1.0] * 14 + [2.0] * 4
    staged.clear()
    assert st.delete_ticker(["A", "A", "none"]) == 1
    assert staged == [["ticker"]]
    st.refresh()
    assert _rows(st.scan_prices().groupBy("ticker").count()) == Counter({("B", 6): 1, ("C", 6): 1})


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_deletion_beside_few_and_many_tickers(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("tickwise.sources.store.FEW_KEYS", few)
    st = Store(spark, str(tmp_path / "s"), buckets=2)
    st.write_prices(_prices(spark, 6))
    assert st.delete_ticker(spark.createDataFrame([("A",), ("A",), (None,), ("B",)], "ticker string")) == 1
    st.refresh()
    assert _rows(st.scan_prices().groupBy("ticker").count()) == Counter({("C", 6): 1})
    assert st.delete_ticker("C") == 1 and st.scan_prices().count() == 0
