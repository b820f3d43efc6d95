"""Scalar column helpers. All are built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hash buckets of a new table's ticker sub-partition, unless its Store is given a number that fits
# the table (about one bucket per GB and year). The number is kept with the table.
TICKER_BUCKETS = 16


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (ANSI-safe; D16)."""
    return F.try_divide(_c(a), _c(b))


def round_2(x) -> Column:
    return F.round(_c(x), 2)


def round_4(x) -> Column:
    return F.round(_c(x), 4)


def year_of_date(c="date") -> Column:
    return F.year(_c(c)).cast("bigint")


def quarter_end(c="date") -> Column:
    """Last day of the calendar quarter containing the date."""
    d = _c(c)
    return F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)))


def parse_iso_date(c) -> Column:
    return F.to_date(_c(c), "yyyy-MM-dd")


def free_cash_flow(ocf="operating_cash_flow", capex="capex") -> Column:
    """Operating cash flow minus |capex|; null propagates."""
    return _c(ocf) - F.abs(_c(capex))


def metric_label(c) -> Column:
    """'pe_ratio' -> 'Pe Ratio'."""
    return F.initcap(F.regexp_replace(_c(c), "_", " "))


def candle_colour(close="close", open_="open") -> Column:
    return F.when(_c(close) < _c(open_), F.lit("red")).otherwise(F.lit("green"))


def ticker_bucket(c="ticker", buckets: int = TICKER_BUCKETS) -> Column:
    """Stable hash bucket of a ticker, used as a directory partition key."""
    return F.pmod(F.xxhash64(_c(c)), F.lit(buckets)).cast("int")


def spark_bucket(c="ticker", buckets: int = TICKER_BUCKETS) -> Column:
    """The bucket that Spark itself gives a ticker: in bucketed tables, and in ``repartition(buckets, "ticker")``."""
    return F.pmod(F.hash(_c(c)), F.lit(buckets)).cast("int")


def add_ticker_column(df: DataFrame, ticker: str) -> DataFrame:
    """Literal ticker column when the frame has none."""
    if "ticker" in df.columns:
        return df
    return df.withColumn("ticker", F.lit(ticker))
