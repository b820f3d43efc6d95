"""Writer / reader behaviour (the reference's test suite, on Spark tables)."""

from __future__ import annotations

import os

import pytest

from pyspark.sql import functions as F

from tests.conftest import PRICE_SCHEMA, d


def _dirs(path):
    return sorted(n for n in os.listdir(path) if "=" in n)


class TestWriter:
    def test_write_prices_single_year(self, store, sample_prices_df):
        n = store.write_prices(sample_prices_df, "AAPL")
        assert n == 1
        assert _dirs(store.path("prices")) == ["year=2024"]
        df = store.scan_prices()
        assert df.count() == 6
        assert [r.ticker for r in df.select("ticker").distinct().collect()] == ["AAPL"]

    def test_write_prices_multiple_years(self, spark, store):
        df = spark.createDataFrame([
            (d("2023-12-29"), 100.0, 101.0, 99.0, 100.5, 100.0, 1000000),
            (d("2024-01-02"), 101.0, 102.0, 100.0, 101.5, 101.0, 1100000),
            (d("2024-01-03"), 102.0, 103.0, 101.0, 102.5, 102.0, 1200000)], PRICE_SCHEMA)
        store.write_prices(df, "MSFT")
        assert _dirs(store.path("prices")) == ["year=2023", "year=2024"]

    def test_write_prices_empty_df(self, spark, store):
        empty = spark.createDataFrame([], "date date, close double")
        assert store.write_prices(empty, "AAPL") == 0
        assert not os.path.exists(store.path("prices"))

    def test_write_fundamentals_quarterly(self, store, sample_fundamentals_df):
        store.write_fundamentals_quarterly(sample_fundamentals_df, "AAPL")
        df = store.scan_fundamentals_quarterly()
        assert df.count() == 4
        assert df.first().ticker == "AAPL"
        assert "rd_expense" in df.columns

    def test_write_metadata(self, spark, store):
        meta = spark.createDataFrame([("AAPL", "Apple Inc."), ("MSFT", "Microsoft Corp.")],
                                     "ticker string, company_name string")
        path = store.write_metadata(meta, "companies")
        assert path.endswith("metadata/companies")
        assert store.read_metadata("companies").count() == 2

    def test_append_prices(self, spark, store, sample_prices_df):
        store.write_prices(sample_prices_df, "AAPL")
        new = spark.createDataFrame([
            (d("2024-01-09"), 155.0, 157.0, 154.0, 156.0, 155.5, 1400000),
            (d("2024-01-10"), 156.0, 158.0, 155.0, 157.0, 156.5, 1500000)], PRICE_SCHEMA)
        store.append_prices(new, "AAPL")
        df = store.scan_prices()
        assert df.count() == 7
        assert df.agg(F.max("close")).first()[0] == 157.0
        # the duplicate date takes the new row
        assert df.where(F.col("date") == d("2024-01-09")).first().close == 156.0

    def test_append_dedupes_within_new_partition(self, spark, store):
        # D23: a batch with a repeated date is de-duplicated even for a new partition
        new = spark.createDataFrame([
            (d("2024-01-09"), 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1),
            (d("2024-01-09"), 2.0, 2.0, 2.0, 2.0, 2.0, 2, 2)], PRICE_SCHEMA + ", seq int")
        store.append_prices(new, "AAPL", order_col="seq")
        rows = store.scan_prices().collect()
        assert len(rows) == 1 and rows[0].close == 2.0
        assert "seq" not in store.scan_prices().columns
        # an existing key updated by a batch with repeats: the highest seq wins
        store.append_prices(new.withColumn("seq", 3 - F.col("seq")), "AAPL", order_col="seq")
        rows = store.scan_prices().collect()
        assert len(rows) == 1 and rows[0].close == 1.0

    def test_delete_ticker(self, store, sample_prices_df, sample_fundamentals_df):
        store.write_prices(sample_prices_df, "AAPL")
        store.write_fundamentals_quarterly(sample_fundamentals_df, "AAPL")
        assert store.delete_ticker("AAPL") == 2
        assert store.scan_prices().count() == 0
        assert store.scan_fundamentals_quarterly().count() == 0
        # the emptied partition directories are gone (dynamic overwrite would keep them)
        assert _dirs(store.path("prices")) == []

    def test_delete_keeps_neighbours(self, store, sample_prices_df):
        for t in ("AAPL", "MSFT", "GOOGL", "AMZN"):
            store.write_prices(sample_prices_df, t)
        assert store.delete_ticker(["MSFT"]) == 1
        left = sorted(r.ticker for r in store.list_tickers().collect())
        assert left == ["AAPL", "AMZN", "GOOGL"]
        assert store.scan_prices().count() == 18

    def test_write_prices_replaces_only_touched_years(self, spark, store, sample_prices_df):
        old = spark.createDataFrame([(d("2023-12-29"), 1.0, 1.0, 1.0, 1.0, 1.0, 1)], PRICE_SCHEMA)
        store.write_prices(old, "AAPL")
        store.write_prices(sample_prices_df, "MSFT")
        store.write_prices(sample_prices_df, "AAPL")
        assert store.scan_prices("AAPL").count() == 7       # 2023 kept (D21)
        assert store.scan_prices("MSFT").count() == 6       # neighbour in same partitions kept
        store.write_prices(sample_prices_df.where("date <= '2024-01-03'"), "AAPL")
        assert store.scan_prices("AAPL").count() == 3       # 2024 slice replaced


class TestReader:
    def test_get_prices_single_ticker(self, store, sample_prices_df):
        store.write_prices(sample_prices_df, "AAPL")
        store.write_prices(sample_prices_df, "MSFT")
        df = store.scan_prices(ticker="AAPL")
        assert df.count() == 6
        assert [r[0] for r in df.select("ticker").distinct().collect()] == ["AAPL"]

    def test_single_ticker_prunes_buckets(self, store, sample_prices_df):
        store.write_prices(sample_prices_df, "AAPL")
        plan = store.scan_prices(ticker="AAPL")._jdf.queryExecution().executedPlan().toString()
        assert "ticker_bucket" in plan.split("PartitionFilters")[1].split("]")[0]

    def test_get_prices_with_date_filter(self, store, sample_prices_df):
        store.write_prices(sample_prices_df, "AAPL")
        df = store.scan_prices(ticker="AAPL", start_date=d("2024-01-04"), end_date=d("2024-01-08"))
        assert df.count() == 3

    def test_get_prices_with_columns(self, store, sample_prices_df):
        store.write_prices(sample_prices_df, "AAPL")
        df = store.scan_prices(ticker="AAPL", columns=["close", "volume"])
        assert df.columns == ["ticker", "date", "close", "volume"]   # D20: fixed order

    def test_get_prices_no_data(self, store):
        df = store.scan_prices(ticker="AAPL")
        assert df.count() == 0
        assert "close" in df.columns                                  # D9: schema kept

    def test_get_fundamentals_quarterly(self, store, sample_fundamentals_df):
        store.write_fundamentals_quarterly(sample_fundamentals_df, "AAPL")
        df = store.scan_fundamentals_quarterly(ticker="AAPL")
        assert df.count() == 4 and "revenue" in df.columns

    def test_get_latest_price(self, store, sample_prices_df):
        from tickwise.operators.prices import latest_price
        store.write_prices(sample_prices_df, "AAPL")
        rows = latest_price(store.scan_prices("AAPL")).collect()
        assert len(rows) == 1
        assert rows[0].date == d("2024-01-09") and rows[0].close == 155.0

    def test_get_ttm_fundamentals(self, store, sample_fundamentals_df):
        from tickwise.operators.ttm import ttm_fundamentals
        store.write_fundamentals_quarterly(sample_fundamentals_df, "AAPL")
        rows = ttm_fundamentals(store.scan_fundamentals_quarterly("AAPL")).collect()
        assert len(rows) == 1
        assert rows[0].quarters_included == 4
        assert rows[0].revenue == 435000.0

    def test_list_tickers(self, store, sample_prices_df):
        for t in ("AAPL", "MSFT", "GOOGL"):
            store.write_prices(sample_prices_df, t)
        assert [r.ticker for r in store.list_tickers().collect()] == ["AAPL", "GOOGL", "MSFT"]

    def test_get_date_range(self, store, sample_prices_df):
        from tickwise.operators.prices import date_range
        store.write_prices(sample_prices_df, "AAPL")
        r = date_range(store.scan_prices("AAPL")).first()
        assert (r.min_date, r.max_date) == (d("2024-01-02"), d("2024-01-09"))

    def test_has_data(self, spark, store, sample_prices_df):
        from tickwise.operators.sets import ticker_frame
        from tickwise.sources.ingest import has_data
        store.write_prices(sample_prices_df, "AAPL")
        out = {r.ticker: r for r in has_data(
            ticker_frame(spark, ["AAPL", "MSFT"]), store.scan_prices(),
            store.scan_fundamentals_quarterly(), store.scan_fundamentals_annual()).collect()}
        assert out["AAPL"].prices is True and out["AAPL"].quarterly is False
        assert out["MSFT"].prices is False

    def test_get_metadata(self, spark, store):
        store.write_metadata(spark.createDataFrame([("AAPL", "Technology")],
                                                   "ticker string, sector string"), "companies")
        df = store.read_metadata("companies")
        assert df.count() == 1 and df.first().sector == "Technology"

    def test_get_metadata_not_found(self, store):
        assert store.read_metadata("nonexistent").count() == 0


def test_layouts_agree(store, ticker_store, sample_prices_df, spark):
    """Both directory layouts give the same rows through replace / upsert / delete."""
    for st in (store, ticker_store):
        for t in ("AAPL", "MSFT", "BRK.B"):
            st.write_prices(sample_prices_df, t)
        st.append_prices(sample_prices_df.withColumn("close", F.col("close") + 1)
                         .where("date >= '2024-01-05'"), "MSFT")
        st.delete_ticker("AAPL")
    a = sorted(map(tuple, store.scan_prices().collect()))
    b = sorted(map(tuple, ticker_store.scan_prices().select(*store.scan_prices().columns)
                   .collect()))
    assert a == b and len(a) == 12


def test_numeric_tickers_stay_strings(spark, ticker_store, store, sample_prices_df):
    for st in (ticker_store, store):
        for name in ("1E5", "123", "007"):
            st.write_prices(sample_prices_df, name)
        st.refresh()
        assert {r.ticker for r in st.scan_prices().select("ticker").distinct().collect()} == {"1E5", "123", "007"}
        assert st.scan_prices("007").count() == 6


def test_bucket_number_is_kept_with_the_table(spark, tmp_path, sample_prices_df):
    from tickwise.sources.store import Store
    names = [f"T{i}" for i in range(40)]
    px = sample_prices_df.crossJoin(spark.createDataFrame([(n,) for n in names], "ticker string"))
    Store(spark, str(tmp_path / "b"), buckets=24).write_prices(px)
    other = Store(spark, str(tmp_path / "b"), buckets=7)
    assert all(other.scan_prices(n).count() == 6 for n in names)
    other.append_prices(px.withColumn("close", F.col("close") + 1))
    assert other.scan_prices().count() == 240 and other.buckets("prices") == 24


def test_no_staging_files_remain(spark, store, sample_prices_df):
    store.write_prices(sample_prices_df, "AAPL")
    store.append_prices(sample_prices_df.withColumn("close", F.col("close") + 1), "AAPL")
    store.delete_ticker("AAPL")
    assert not [f for f in _files(store.root) if "_staging" in f]


def test_one_row_per_key(spark, store, sample_prices_df, sample_fundamentals_df):
    store.write_prices(sample_prices_df.unionByName(sample_prices_df), "AAPL")
    assert store.scan_prices().count() == 6
    later = sample_fundamentals_df.withColumn("fiscal_year", F.col("fiscal_year") + 1).withColumn("revenue", F.lit(1.0))
    store.write_fundamentals(sample_fundamentals_df.unionByName(later), "quarterly", "AAPL")
    got = store.scan_fundamentals_quarterly()
    assert got.count() == 4 and {r.revenue for r in got.collect()} == {1.0}


def test_upsert_is_idempotent(store, sample_prices_df):
    store.write_prices(sample_prices_df, "AAPL")
    batch = sample_prices_df.withColumn("close", F.col("close") * 2).where("date >= '2024-01-05'")
    store.append_prices(batch, "AAPL")
    once = sorted(map(tuple, store.scan_prices().collect()))
    store.append_prices(batch, "AAPL")
    assert sorted(map(tuple, store.scan_prices().collect())) == once


def test_facade_round_trip(spark, tmp_path, sample_prices_df, sample_fundamentals_df):
    from tickwise.plans.facade import Tickwise
    tw = Tickwise(spark, str(tmp_path / "fac"))
    px = sample_prices_df.withColumn("ticker", F.lit("AAPL"))
    fq = sample_fundamentals_df.withColumn("ticker", F.lit("AAPL"))
    s = tw.update_data(px, fq, start_date="2024-01-01")
    assert s == {"tickers_processed": 1, "prices_written": 6, "fundamentals_written": 4, "rows_dropped": 0,
                 "errors": []}
    assert tw.has_data("AAPL").first().asDict() == {"ticker": "AAPL", "prices": True, "quarterly": True, "annual": False}
    assert [r.label for r in tw.ranking("pe_ratio").collect()] == ["17.61"]
    assert tw.margin_trend("AAPL").count() == tw.revenue_earnings("AAPL").count() == 4
    assert [r.ticker for r in tw.compare("AAPL").collect()] == ["AAPL"]
    assert tw.get_latest_price("AAPL")["close"] == 155.0
    assert tw.get_pe("AAPL") == 17.61
    r = tw.get_ratios("AAPL")
    assert r["gross_margin"] == 0.4 and r["as_of_date"] == "latest"
    assert [x.ticker for x in tw.screen(pe_max=20).collect()] == ["AAPL"]
    assert tw.screen(pe_max=10).count() == 0
    assert [tuple(x) for x in tw.rank("pe_ratio").collect()] == [(1, "AAPL", 17.61)]
    assert tw.candlestick("AAPL").count() == 6
    feed = px.withColumn("date", F.date_add("date", 30))
    assert tw.update_prices(feed) == {"tickers_updated": 1, "new_records": 6}
    assert tw.get_prices("AAPL").count() == 12


def _files(path):
    out = set()
    for root, _, names in os.walk(path):
        out |= {os.path.join(root, n) for n in names if n.endswith(".parquet")}
    return out


def test_append_of_new_dates_rewrites_nothing(spark, store, sample_prices_df):
    store.write_prices(sample_prices_df, "AAPL")
    before = _files(store.path("prices"))
    later = sample_prices_df.withColumn("date", F.date_add("date", 10))
    store.append_prices(later, "AAPL")
    after = _files(store.path("prices"))
    assert before < after                      # old files kept, new files added
    assert store.scan_prices().count() == 12


def test_null_keys_dropped_and_statement_keys_unique(spark, store, sample_fundamentals_df):
    dup = sample_fundamentals_df.unionByName(sample_fundamentals_df.limit(1))
    store.write_fundamentals_quarterly(dup, "AAPL")
    assert store.scan_fundamentals_quarterly().count() == 4
    rows = [(None, 1.0), (d("2024-01-02"), 2.0)]
    px = spark.createDataFrame(rows, "date date, close double")
    store.write_prices(px, "AAPL")
    assert store.scan_prices().count() == 1


def test_metadata_is_replaced_at_once(spark, store):
    first = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, v int")
    store.write_metadata(first, "companies")
    seen = store.read_metadata("companies")
    broken = first.withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        store.write_metadata(broken, "companies")
    assert sorted(map(tuple, store.read_metadata("companies").collect())) == [("A", 1), ("B", 2)]
    for k in (10, 20):  # a replacement may read what it replaces; a reader keeps what it opened
        store.write_metadata(store.read_metadata("companies").withColumn("v", F.col("v") + k), "companies")
        if k == 10:
            assert sorted(map(tuple, seen.collect())) == [("A", 1), ("B", 2)]
    assert sorted(map(tuple, store.read_metadata("companies").collect())) == [("A", 31), ("B", 32)]
