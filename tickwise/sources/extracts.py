"""Vendor bulk-extract files (CSV or Parquet) mapped onto our schemas.

Renames apply only to vendor columns that are present; other columns are
kept. Known columns are cast to the canonical types; a malformed value becomes null
instead of stopping the load (``malformed`` counts them). ``load_with_rejects`` keeps rows with such values, without a key, or
with too few or too many fields apart, with the reason, in the same reading of the file. The statement loaders take the
period: a quarterly and an annual extract are two different files (D10), and where a
file holds both, the vendor's label tells them apart (``FY`` is annual).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.schemas import (BALANCE_COLUMN_MAP, CASHFLOW_COLUMN_MAP, FUNDAMENTALS,
                              INCOME_COLUMN_MAP, PRICE_COLUMN_MAP, PRICES)


def _read(spark: SparkSession, path: str, fmt: str, sep: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", "true").option("sep", sep).csv(path)
    return spark.read.format(fmt).load(path)


def _conform(df: DataFrame, mapping: dict, schema) -> DataFrame:
    ren = {k: v for k, v in mapping.items() if k in df.columns and v not in df.columns}
    df = df.withColumnsRenamed(ren)
    known = {f.name: f.dataType for f in schema.fields}
    return df.select(*[F.col(f"`{c}`").try_cast(known[c]).alias(c) if c in known else F.col(f"`{c}`")
                       for c in df.columns])


def malformed(raw: DataFrame, mapping: dict, schema) -> DataFrame:
    """One row: for each known column of a vendor frame, how many values its type does not take."""
    names = {c: mapping.get(c, c) for c in raw.columns}
    known = {f.name: f.dataType for f in schema.fields}
    bad = [F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")
                      & F.col(f"`{c}`").try_cast(known[n]).isNull()).alias(n)
           for c, n in names.items() if n in known]
    return raw.agg(*bad)


def conform_prices(df: DataFrame) -> DataFrame:
    """Vendor or fixture price columns -> our names and types."""
    return _conform(df, PRICE_COLUMN_MAP, PRICES)


def conform_fundamentals(df: DataFrame) -> DataFrame:
    """Vendor or fixture statement columns -> our names and types (any statement)."""
    mapping = {**INCOME_COLUMN_MAP, **BALANCE_COLUMN_MAP, **CASHFLOW_COLUMN_MAP}
    return _conform(df, mapping, FUNDAMENTALS)


def _ticker(df: DataFrame, ticker: str | None) -> DataFrame:
    return df if ticker is None else df.where(F.col("ticker") == F.lit(ticker))


def load_prices_extract(spark, path, fmt="csv", sep=";", ticker=None) -> DataFrame:
    return _ticker(_conform(_read(spark, path, fmt, sep), PRICE_COLUMN_MAP, PRICES), ticker)


def _statement(spark, path, mapping, fmt, sep, ticker, period) -> DataFrame:
    if period not in (None, "quarterly", "annual"):
        raise ValueError("period must be 'quarterly' or 'annual'")
    df = _ticker(_conform(_read(spark, path, fmt, sep), mapping, FUNDAMENTALS), ticker)
    if period is None or "fiscal_label" not in df.columns:
        return df
    full_year = F.upper("fiscal_label").startswith("FY")
    return df.where(F.col("fiscal_label").isNull() | (full_year if period == "annual" else ~full_year))


def load_income_extract(spark, path, fmt="csv", sep=";", ticker=None, period=None) -> DataFrame:
    return _statement(spark, path, INCOME_COLUMN_MAP, fmt, sep, ticker, period)


def load_balance_extract(spark, path, fmt="csv", sep=";", ticker=None, period=None) -> DataFrame:
    return _statement(spark, path, BALANCE_COLUMN_MAP, fmt, sep, ticker, period)


def load_cashflow_extract(spark, path, fmt="csv", sep=";", ticker=None, period=None) -> DataFrame:
    return _statement(spark, path, CASHFLOW_COLUMN_MAP, fmt, sep, ticker, period)


def load_companies_extract(spark, path, fmt="csv", sep=";") -> DataFrame:
    """Company dimension: no renames (the vendor's ``Ticker`` header is lower-cased)."""
    df = _read(spark, path, fmt, sep)
    return df.withColumnsRenamed({"Ticker": "ticker"}) if "Ticker" in df.columns else df


def list_available_tickers(feed: DataFrame) -> DataFrame:
    """Sorted distinct non-null tickers of a price feed."""
    return feed.select("ticker").where(F.col("ticker").isNotNull()).distinct().orderBy("ticker")


class Loaded(NamedTuple):
    """What ``load_with_rejects`` read: good rows, rejected ones, and how many of each."""

    rows: DataFrame
    rejects: DataFrame
    n_rows: int
    n_rejects: int


KINDS = {"prices": (PRICE_COLUMN_MAP, PRICES, ["ticker", "date"]),
         "income": (INCOME_COLUMN_MAP, FUNDAMENTALS, ["ticker", "fiscal_period"]),
         "balance": (BALANCE_COLUMN_MAP, FUNDAMENTALS, ["ticker", "fiscal_period"]),
         "cashflow": (CASHFLOW_COLUMN_MAP, FUNDAMENTALS, ["ticker", "fiscal_period"])}
CORRUPT = "_corrupt_record"


def load_with_rejects(spark: SparkSession, path: str, kind: str, target: str, fmt: str = "csv",
                      sep: str = ";") -> Loaded:
    """A vendor extract (``KINDS``) with its faulty rows kept apart.

    The file is read once: every row is written below ``target``, to ``rejected=false`` or ``rejected=true``, and the two
    frames read one of them each. Good rows are what the plain loaders give. A reject is (file, reasons, raw): the
    source file, every fault found, and the row as JSON, a line with a wrong number of fields as it stands.
    """
    mapping, schema, keys = KINDS[kind]
    raw = _read(spark, path, fmt, sep)
    names = raw.columns
    if fmt == "csv":
        fields = T.StructType([*raw.schema.fields, T.StructField(CORRUPT, T.StringType())])
        raw = (spark.read.option("header", "true").option("sep", sep).option("columnNameOfCorruptRecord", CORRUPT)
               .schema(fields).csv(path))
        broken = F.col(CORRUPT)
    else:
        broken = F.lit(None).cast("string")
    renamed = {c: mapping[c] if c in mapping and mapping[c] not in names else c for c in names}
    known = {f.name: f.dataType for f in schema.fields}
    faults = [F.when(broken.isNotNull(), F.lit("wrong number of fields"))]
    for c, n in renamed.items():
        given = F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "")
        if n in known:
            faults.append(F.when(broken.isNull() & given & F.col(f"`{c}`").try_cast(known[n]).isNull(), F.lit(f"{n}: malformed")))
        if n in keys:
            faults.append(F.when(broken.isNull() & ~F.coalesce(given, F.lit(False)), F.lit(f"{n}: missing")))
    seen = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.array_compact(F.array(*faults)).alias("_reasons"))
    values = [(F.col(f"`{c}`").try_cast(known[n]) if n in known else F.col(f"`{c}`")).alias(n) for c, n in renamed.items()]
    line = F.coalesce(broken, F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    bad = F.size("_reasons") > 0
    watch = Observation()
    (seen.select(F.when(~bad, F.struct(*values)).alias("row"),
                 F.when(bad, F.struct(F.col("_file").alias("file"), F.col("_reasons").alias("reasons"), line.alias("raw"))).alias("reject"),
                 bad.alias("rejected"))
     .observe(watch, F.count_if(~F.col("rejected")).alias("rows"), F.count_if("rejected").alias("rejects"))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("rejected").parquet(target))
    types = T.StructType([T.StructField("row", T.StructType([
        T.StructField(n, known[n] if n in known else raw.schema[c].dataType) for c, n in renamed.items()])),
        T.StructField("reject", T.StructType.fromDDL("file string, reasons array<string>, raw string")),
        T.StructField("rejected", T.BooleanType())])
    stored = spark.read.schema(types).parquet(target)
    return Loaded(stored.where("not rejected").select("row.*"), stored.where("rejected").select("reject.*"),
                  watch.get["rows"], watch.get["rejects"])
