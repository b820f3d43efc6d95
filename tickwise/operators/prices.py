"""Price-side operators: newest price, as-of price, date ranges, price index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalar import safe_div
from tickwise.session import ensure_checkpoint_dir


def latest_price(prices: DataFrame) -> DataFrame:
    """Newest price row per ticker (``max_by`` on date: one partial aggregate)."""
    rest = [c for c in prices.columns if c != "ticker"]
    return (prices.groupBy("ticker")
            .agg(F.max_by(F.struct(*rest), "date").alias("_p"))
            .select("ticker", *[F.col(f"_p.{c}").alias(c) for c in rest]))


def price_as_of(prices: DataFrame, as_of) -> DataFrame:
    """Last price row on or before ``as_of`` per ticker."""
    return latest_price(prices.where(F.col("date") <= F.lit(as_of).cast("date")))


def date_range(prices: DataFrame) -> DataFrame:
    """min/max price date per ticker."""
    return prices.groupBy("ticker").agg(F.min("date").alias("min_date"),
                                        F.max("date").alias("max_date"))


def normalize_price(prices: DataFrame, base: float = 100.0) -> DataFrame:
    """close / first close of the range * 100, per ticker.

    The first close comes from a ``min_by`` aggregate (one row per ticker)
    joined back on ticker rather than a per-ticker window. The aggregate is
    stored first: both sides of the join are then plain shuffles, and AQE can
    split a ticker that holds a large share of the rows over several tasks.
    """
    ensure_checkpoint_dir(prices.sparkSession)
    first = prices.groupBy("ticker").agg(F.min_by("close", "date").alias("_base")).checkpoint()
    return (prices.join(first, "ticker")
            .withColumn("close", safe_div(F.col("close"), F.col("_base")) * F.lit(base))
            .drop("_base"))
