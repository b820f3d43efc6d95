"""Tables bucketed by ticker in the catalog: plans without exchange, sinks, hot tickers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.test_plans import SF, _hot_prices, _plan, needs_data, no_broadcast  # noqa: F401
from tickwise.operators import filters as FL
from tickwise.operators import ratios as R
from tickwise.plans.registry import _price_x_ttm
from tickwise.sources.bridge import Bridge
from tickwise.sources.catalog import CatalogStore
from tickwise.sources.store import Store


@pytest.fixture
def catalog(spark, tmp_path):
    return CatalogStore(spark, str(tmp_path / "catalog"), buckets=6)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@needs_data
def test_no_exchange_over_stored_tables(spark, catalog, no_broadcast):  # noqa: F811
    b = Bridge(spark, SF, "sparse")
    catalog.write_prices(b.prices())
    catalog.write_fundamentals(b.fundamentals())
    px, fq = catalog.scan_prices(), catalog.scan_fundamentals_quarterly()
    ratios = R.ratio_table(px, fq)
    screened = FL.screen_stocks(R.ratio_table(px, fq), {"pe_ratio": (0, 25)})
    for df in (ratios, screened, _price_x_ttm(px, fq), R.ratio_table(px, fq, as_of="1997-12-31")):
        plan = _plan(df)
        assert "Exchange" not in plan, plan
        assert plan.count("Bucketed: true") >= 2
    assert _rows(ratios) == _rows(R.ratio_table(b.prices(), b.fundamentals()))
    one = R.all_ratios(catalog.scan_prices("P7"), catalog.scan_fundamentals_quarterly("P7"), "P7")
    assert one.drop("as_of_date").first() == ratios.where("ticker = 'P7'").drop("as_of_date").first()


@needs_data
def test_a_folder_holds_one_bucket(spark, catalog):
    catalog.write_prices(Bridge(spark, SF, "sparse").prices())
    for folder, _, files in os.walk(catalog.path("prices")):
        ids = {f.split("_")[-1].split(".")[0] for f in files if f.endswith(".parquet")}
        assert not ids or {int(i) for i in ids} == {int(folder.split("ticker_bucket=")[1])}


@needs_data
def test_sinks_agree_with_the_plain_store(spark, catalog, tmp_path):
    plain = Store(spark, str(tmp_path / "plain"))
    px = Bridge(spark, SF, "sparse").prices()
    late = px.where("date >= '1998-06-01'").withColumn("close", F.col("close") + 1)
    extra = px.where("ticker = 'P3'").withColumn("note", F.lit("seen")).withColumn("date", F.date_add("date", 9000)).drop("year")
    for st in (plain, catalog):
        st.write_prices(px.where("date < '1999-01-01'"))
        st.append_prices(late)
        st.write_prices(px.where("year = 1995").withColumn("volume", F.lit(5).cast("long")))
        st.append_prices(extra)
        assert st.delete_ticker(["P1", "P7", "nope"]) == 1
        st.delete_ticker(px.select("ticker").where("ticker like 'P1%'"))
    assert _rows(catalog.scan_prices()) == _rows(plain.scan_prices())
    # a session that does not know the tables registers them from the folder
    for table in ("prices",):
        spark.sql(f"DROP TABLE {catalog.table_name(table)}")
    again = CatalogStore(spark, catalog.root)
    assert _rows(again.scan_prices()) == _rows(plain.scan_prices()) and again.buckets("prices") == 6
    assert again.scan_prices("P30").count() == plain.scan_prices("P30").count() > 0


def test_a_hot_ticker_is_split(spark, catalog, no_broadcast):  # noqa: F811
    px = _hot_prices(spark)
    catalog.write_prices(px.select("*", *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "adjusted_close")],
                                   F.lit(1).cast("long").alias("volume")))
    newest = lambda st: st.scan_prices().groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    calm = newest(catalog)
    assert "Exchange" not in _plan(calm)
    wary = CatalogStore(spark, catalog.root, hot_factor=1.2, hot_bytes=0)
    assert wary.hot("prices") and not catalog.hot("prices")
    split = newest(wary)
    plan = _plan(split)
    assert "Bucketed: true" not in plan and "partial_max_by" in plan and plan.count("Exchange hashpartitioning") == 1
    assert _rows(split) == _rows(calm)
