"""Set operators: union, keep-last de-duplication, distinct values, universe resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.schemas import TICKER_ALIASES


def union_all(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Vertical concat by column name (columns missing on one side become null)."""
    return existing.unionByName(new, allowMissingColumns=True)


def dedupe_keep_last(df: DataFrame, keys: list[str], seq: str, unique: bool = False) -> DataFrame:
    """One row per key: the one with the highest ``seq`` (later source wins).

    A ``max_by`` aggregate rather than a row_number window: it is reduced
    inside each map task first, so a key with very many copies never lands
    whole in one task. Equal ``seq`` values are broken by the row's values,
    so the result is deterministic under retries. ``source_position`` makes a ``seq``
    of the rows' order in their files; such a ``unique`` one needs no values beside it.
    """
    rest = [c for c in df.columns if c not in keys]
    if unique:
        rest = [c for c in rest if c != seq]
        order = F.col(seq)
    else:
        order = F.struct(F.col(seq), *[F.col(c) for c in rest if c != seq])
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def source_position(df: DataFrame, name: str = "_position") -> DataFrame | None:
    """``df`` with the place of each row in its source files: (path, where the split begins, row), in reading order.

    For frames that scan files, also through projections and filters; None for others. Rows of one split are
    read by one task in order, so its row numbers rise within a split; files follow each other by path.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                     F.monotonically_increasing_id().alias("row"))
    # no file scan below, or one that was joined, grouped or united, has no such hidden column
    hidden = df._jdf.queryExecution().analyzed().metadataOutput().mkString(" ")
    return df.select("*", place.alias(name)) if "_metadata#" in hidden else None


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def list_tickers(df: DataFrame) -> DataFrame:
    """Sorted distinct non-null tickers."""
    return distinct_values(df, "ticker").orderBy("ticker")


def ticker_frame(spark: SparkSession, tickers) -> DataFrame:
    return spark.createDataFrame([(t,) for t in dict.fromkeys(tickers)], "ticker string")


def resolve_universe(wanted: DataFrame, available: DataFrame,
                     aliases: dict[str, str] | None = None) -> DataFrame:
    """Wanted tickers present in the feed, plus the alias of every wanted symbol
    that is absent while its alias is present; sorted.

    ``wanted`` and ``available`` are frames with a ``ticker`` column; the alias
    map is a small fixed parameter.
    """
    aliases = TICKER_ALIASES if aliases is None else aliases
    spark = wanted.sparkSession
    avail = available.select("ticker").distinct()
    want = wanted.select("ticker").distinct()
    present = want.join(avail, "ticker", "left_semi")
    amap = spark.createDataFrame(list(aliases.items()) or [("", "")],
                                 "ticker string, alias string")
    missing = want.join(avail, "ticker", "left_anti").join(amap, "ticker")
    alt = (missing.select(F.col("alias").alias("ticker"))
           .join(avail, "ticker", "left_semi"))
    return present.unionByName(alt).distinct().orderBy("ticker")
