"""Batch analysis over the one-row-per-ticker ratio table: compare, rank,
group averages, valuation summary, ticker-vs-group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.scalar import metric_label
from tickwise.schemas import RATIO_COLUMNS
from tickwise.session import ensure_checkpoint_dir

RADAR_METRICS = ["operating_margin", "net_profit_margin", "gross_margin", "rd_intensity",
                 "capex_ratio"]


def compare_tickers(ratios: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """ticker plus the chosen metrics that exist (all columns when none given)."""
    if metrics is None:
        return ratios
    return ratios.select("ticker", *[m for m in metrics if m in ratios.columns])


def global_row_number(df: DataFrame, order_cols: list, name: str = "rank") -> DataFrame:
    """1-based row number over a total order, with one exchange of the rows.

    Rows are dealt to ranges and sorted inside them; the upper bits of
    ``monotonically_increasing_id`` are then the range and the lower 33 the
    place in it. Adding the row count of all earlier ranges needs a table of
    one row per range (a bound known from the plan), which is broadcast.
    The numbered rows are checkpointed: range bounds come from a sample drawn
    anew at every evaluation, and both the counts and the rows must see one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number is not merged later
    placed = (df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_id", F.monotonically_increasing_id()))
    ensure_checkpoint_dir(df.sparkSession)
    placed = placed.checkpoint()
    part = F.shiftright("_id", 33).alias("_pid")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (placed.withColumn("_pid", F.shiftright("_id", 33)).join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + place).cast("bigint")).drop("_id", "_pid", "_off"))


def rank_by_metric(ratios: DataFrame, metric: str, ascending: bool = True,
                   top_n: int | None = None) -> DataFrame:
    """rank, ticker, metric; null metric dropped; ties broken by ticker (D12).

    With ``top_n`` the sort is a TakeOrderedAndProject (per-task top-n, then
    merge); without it the ranking is distributed (``global_row_number``).
    Unknown metric gives an empty frame.
    """
    if metric not in ratios.columns:
        return ratios.sparkSession.createDataFrame([], "rank bigint, ticker string, value double")
    m = F.col(metric) if ascending else F.col(metric).desc()
    order = [m, F.col("ticker")]
    df = ratios.where(F.col(metric).isNotNull()).select("ticker", metric)
    if top_n is not None:
        top = df.orderBy(*order).limit(top_n)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        ranked = global_row_number(df, order)
    return ranked.select("rank", "ticker", metric)


def group_averages(ratios: DataFrame, members: DataFrame, group_col: str = "group") -> DataFrame:
    """Mean of each ratio per group (nulls ignored, rounded to 4; null if all null).

    ``members`` is (group, ticker): the requested list per group, so
    ``ticker_count`` counts requested tickers found or not (D18). Means are of
    ratios, not ratios of sums (D19).
    """
    j = members.select(group_col, "ticker").join(ratios, "ticker", "left")
    aggs = [F.round(F.avg(c), 4).alias(c) for c in RATIO_COLUMNS if c in ratios.columns]
    return j.groupBy(group_col).agg(*aggs, F.count("ticker").cast("bigint").alias("ticker_count"))


def valuation_summary(prices: DataFrame, fundamentals: DataFrame, tickers=None) -> DataFrame:
    """Ratios plus latest close/date and TTM revenue / net income, per ticker."""
    from tickwise.operators.ratios import valuation_table
    return valuation_table(prices, fundamentals, tickers)


def unpivot_metrics(df: DataFrame, metrics: list[str], id_cols: list[str],
                    value_name: str = "value") -> DataFrame:
    present = [m for m in metrics if m in df.columns]
    return df.unpivot(id_cols, present, "metric", value_name)


def ticker_vs_group(ratios: DataFrame, members: DataFrame, group_col: str = "group",
                    metrics: list[str] | None = None) -> DataFrame:
    """Each member ticker's non-null radar metrics next to its group's mean (0 if none)."""
    metrics = metrics or RADAR_METRICS
    avgs = group_averages(ratios, members, group_col)
    g = unpivot_metrics(avgs, metrics, [group_col], "group_value")
    t = unpivot_metrics(members.select(group_col, "ticker").join(ratios, "ticker"),
                        metrics, [group_col, "ticker"], "ticker_value")
    t = t.where(F.col("ticker_value").isNotNull())
    return (t.join(g, [group_col, "metric"], "left")
            .select(group_col, "ticker", "metric", metric_label(F.col("metric")).alias("label"),
                    "ticker_value", F.coalesce("group_value", F.lit(0.0)).alias("group_value")))
