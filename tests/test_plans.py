"""Physical-plan properties: pruning reaches the scan, shuffles stay few, no Python."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tickwise.operators import ratios as R
from tickwise.plans.registry import QUERIES
from tickwise.sources.bridge import Bridge

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def stored(store, spark):
    b = Bridge(spark, SF, "medium")
    store.write_prices(b.prices())
    store.write_fundamentals(b.fundamentals())
    return store


@needs_data
def test_ratio_table_shape(stored):
    plan = _plan(R.ratio_table(stored.scan_prices(), stored.scan_fundamentals_quarterly()))
    assert "WindowGroupLimit" in plan and "Partial" in plan      # top-K cut before the shuffle
    assert plan.count("Exchange hashpartitioning") == 2           # one per input table
    assert "partial_max_by" in plan                                # price side pre-aggregated
    assert "ReadSchema: struct<ticker:string,date:date,close:double>" in plan


@needs_data
def test_single_ticker_prunes(stored):
    df = R.all_ratios(stored.scan_prices("S3"), stored.scan_fundamentals_quarterly("S3"), "S3")
    plan = _plan(df)
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert len(scans) == 2
    for s in scans:
        assert "PartitionFilters: [isnotnull(ticker_bucket" in s
        assert "EqualTo(ticker,S3)" in s


@needs_data
def test_date_range_prunes_years(stored):
    plan = _plan(stored.scan_prices(start_date="1998-01-01", end_date="1998-12-31"))
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line)
    assert "year" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date,1998-01-01)" in scan


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plans(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                 "MapInPandas", "PythonUDF"):
        assert node not in plan, f"{name} runs Python: {node}"


def test_dedupe_is_partial_aggregate(spark):
    from tickwise.operators.sets import dedupe_keep_last
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    plan = _plan(dedupe_keep_last(df, ["k"], "seq"))
    assert "partial_max_by" in plan and "Window" not in plan


@needs_data
def test_as_of_prunes_later_years(stored):
    df = R.ratio_table(stored.scan_prices(), stored.scan_fundamentals_quarterly(), as_of="1996-12-31")
    plan = _plan(df)
    scans = [line for line in plan.split("\n")
             if "FileScan parquet" in line and "ReadSchema: struct<ticker:string,date:date" in line]
    assert any("year" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans), scans


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot_prices(spark, n=40_000):
    """Half of the rows belong to one ticker."""
    hot = F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 400).cast("string")))
    return spark.range(0, n, 1, 8).select(
        hot.alias("ticker"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("date"),
        (F.col("id") % 97 + 1).cast("double").alias("close"))


def test_hot_ticker_is_split_in_the_price_index(spark, no_broadcast):
    from tickwise.operators.prices import normalize_price
    assert "skew=true" in _plan(normalize_price(_hot_prices(spark)))


def test_hot_ticker_is_split_in_the_incremental_feed(spark, no_broadcast):
    from tickwise.sources.ingest import incremental_rows
    px = _hot_prices(spark)
    assert "skew=true" in _plan(incremental_rows(px.where("date < '1990-02-01'"), px))


@needs_data
def test_yoy_growth_and_ttm_cut_before_the_shuffle(stored):
    from tickwise.operators import ttm as T
    q = stored.scan_fundamentals_quarterly()
    for df, rows in ((R.yoy_growth(q, "revenue"), 5), (T.ttm_fundamentals(q), 4)):
        plan = _plan(df)
        assert plan.count("Exchange hashpartitioning") == 1
        assert f"row_number(), {rows}, Partial" in plan.replace("WindowGroupLimit", "WindowGroupLimit")


def test_full_rank_moves_rows_once(spark):
    from tickwise.operators.metrics import global_row_number
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ranked = global_row_number(df, ["v"])
    plan = _plan(ranked)
    assert plan.count("rangepartitioning(v") <= 2 and "hashpartitioning(v" not in plan  # one is a reuse or the counts
    assert all(r.rank == r.v + 1 for r in ranked.collect())


def test_full_rank_holds_without_exchange_reuse(spark):
    """Range bounds are sampled at each evaluation: offsets and rows must come from the same one."""
    from tickwise.operators.metrics import global_row_number
    n = 300_000
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("v"), F.rand().alias("noise"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        ranked = global_row_number(df, ["v"])
        assert ranked.where("rank <> v + 1").count() == 0
        assert ranked.select("rank").distinct().count() == n
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
