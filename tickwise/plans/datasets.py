"""Chart-ready tables: the data behind each of the reference's charts (no rendering)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalar import candle_colour, metric_label, safe_div
from tickwise.operators.filters import filter_date_range
from tickwise.operators.metrics import rank_by_metric, ticker_vs_group, unpivot_metrics
from tickwise.operators.prices import normalize_price

DEFAULT_COMPARISON_METRICS = ["pe_ratio", "operating_margin", "net_profit_margin", "gross_margin"]


def candlestick_data(prices: DataFrame, start=None, end=None) -> DataFrame:
    """ticker, date, OHLC, volume and bar colour, in chronological order."""
    df = filter_date_range(prices, start, end)
    return (df.select("ticker", "date", "open", "high", "low", "close", "volume",
                      candle_colour().alias("colour"))
            .orderBy("ticker", "date"))


def price_comparison_data(prices: DataFrame, start=None, end=None,
                          normalize: bool = False) -> DataFrame:
    df = filter_date_range(prices.select("ticker", "date", "close"), start, end)
    if normalize:
        df = normalize_price(df)
    return df.orderBy("ticker", "date")


def ratio_comparison_data(ratios: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Long form (ticker, metric, label, value)."""
    metrics = metrics or DEFAULT_COMPARISON_METRICS
    long = unpivot_metrics(ratios, metrics, ["ticker"])
    return long.select("ticker", "metric", metric_label(F.col("metric")).alias("label"), "value")


def quarter_margins(q: DataFrame) -> DataFrame:
    """Per-quarter gross / operating / net margin, unrounded, null on zero revenue."""
    out = [F.col("ticker"), F.col("fiscal_period")]
    for num, name in (("gross_profit", "gross_margin"), ("operating_income", "operating_margin"),
                      ("net_income", "net_margin")):
        if num in q.columns and "revenue" in q.columns:
            out.append(safe_div(F.col(num), F.col("revenue")).alias(name))
    return q.select(*out)


def margin_trend_data(q: DataFrame) -> DataFrame:
    return quarter_margins(q).orderBy("ticker", "fiscal_period")


def revenue_earnings_data(q: DataFrame) -> DataFrame:
    cols = [c for c in ("revenue", "net_income") if c in q.columns]
    return q.select("ticker", "fiscal_period", *cols).orderBy("ticker", "fiscal_period")


def ranking_data(ratios: DataFrame, metric: str, top_n: int = 10,
                 ascending: bool = True) -> DataFrame:
    r = rank_by_metric(ratios, metric, ascending, top_n)
    if metric not in r.columns:  # unknown metric: no bars
        return r.withColumn("label", F.lit(""))
    # bar text: two decimals, empty for a zero value
    label = F.when(F.col(metric) != 0, F.format_string("%.2f", F.col(metric))).otherwise("")
    return r.withColumn("label", label)


def group_radar_data(ratios: DataFrame, members: DataFrame, group_col: str = "group") -> DataFrame:
    return ticker_vs_group(ratios, members, group_col)


def recent_statements(q: DataFrame, columns: list[str], n: int = 8) -> DataFrame:
    """The newest n quarters of the chosen columns per ticker."""
    from tickwise.operators.ttm import newest_n_quarters
    keep = [c for c in columns if c in q.columns]
    return newest_n_quarters(q, n).select("ticker", "fiscal_period", "rn", *keep)
