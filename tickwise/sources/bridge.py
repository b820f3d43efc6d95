"""Equity-shaped tables derived from the TPC-H-style test tables.

``lineitem JOIN part`` becomes daily prices and quarterly / annual statements.
A ticker is a brand (dense), a supplier (medium) or a part (sparse). Money is
summed as DECIMAL and cast to DOUBLE only after summing, so the result does
not depend on the order rows reach an aggregate.

Every table is one ``groupBy`` over the joined rows; all aggregates used here
(sum, min, max, min_by, max_by) are partial aggregates, so a hot ticker is
pre-aggregated inside each map task before the shuffle.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.functions.scalar import TICKER_BUCKETS, quarter_end
from tickwise.session import shared_dir

DENSITIES = ("dense", "medium", "sparse")
MONEY = "decimal(18,2)"
RATE = "decimal(4,2)"


def ticker_expr(density: str) -> Column:
    if density == "dense":
        return F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("B"))
    if density == "medium":
        return F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    if density == "sparse":
        return F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    raise ValueError(f"unknown density {density!r}; expected one of {DENSITIES}")


PRICE_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
               "l_shipdate"]
LINES = [*PRICE_LINES, "l_tax", "l_returnflag", "l_linestatus"]
BUCKET_BYTES = 32 << 20  # about two million lines of Parquet
PARTS = ["p_partkey", "p_brand", "p_size", "p_retailprice"]


def line_rows(spark: SparkSession, sf_dir: str, density: str = "dense") -> DataFrame:
    """One row per lineitem with its part attributes and typed money columns."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINES)
    pt = spark.read.parquet(f"{sf_dir}/part.parquet").select(*PARTS)
    return typed_rows(li.join(pt, li.l_partkey == pt.p_partkey).withColumn("ticker", ticker_expr(density)))


def typed_rows(j: DataFrame) -> DataFrame:
    """The joined lines with typed money columns, as far as ``j`` has them."""
    out = {"ticker": F.col("ticker"), "d": F.col("l_shipdate").cast("date"),
           "px": F.try_divide("l_extendedprice", "l_quantity"),
           "qty": F.col("l_quantity").cast(MONEY), "ep": F.col("l_extendedprice").cast(MONEY),
           "disc": F.col("l_discount").cast(RATE), "l_discount": F.col("l_discount"),
           # (orderkey, linenumber) alone is not unique; with part and supplier it is
           "seq": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}
    if "l_tax" in j.columns:
        out |= {"rp": F.col("p_retailprice").cast(MONEY), "tax": F.col("l_tax").cast(RATE), "p_size": F.col("p_size"),
                "rf": F.col("l_returnflag"), "ls": F.col("l_linestatus")}
    return j.select(*[c.alias(n) for n, c in out.items()])


def rows_by_ticker(spark: SparkSession, sf_dir: str, density: str, statements: bool) -> DataFrame:
    """The rows of ``line_rows`` moved once: a table bucketed by ticker, which every later step per ticker reads as it is.

    Without ``statements`` only what prices need is kept. A part is a sparse ticker, so there the ticker is the join's key
    too and the lines' exchange serves the join as well; the part's number is read off it. The table has a multiple of a
    store's buckets, so that a task's rows belong to one of those, and a bucket per ``BUCKET_BYTES`` of the lines' files.
    """
    size = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/lineitem.parquet")
            .agg(F.sum("length")).first()[0] or 0)
    n = TICKER_BUCKETS * max(1, -(-size // (TICKER_BUCKETS * BUCKET_BYTES)))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*(LINES if statements else PRICE_LINES))
    li = li.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))  # all that is read of it; half as wide
    pt = spark.read.parquet(f"{sf_dir}/part.parquet").select(*PARTS)
    if density == "sparse":
        pt = pt.withColumn("ticker", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
        moved = li.withColumn("ticker", ticker_expr(density)).drop("l_partkey").repartition(n, "ticker")
        j = moved.join(pt, "ticker").withColumn("l_partkey", F.col("p_partkey").cast(li.schema["l_partkey"].dataType))
    else:
        j = li.join(pt, li.l_partkey == pt.p_partkey).withColumn("ticker", ticker_expr(density))
    j = j.select("ticker", *li.columns, *(["p_size", "p_retailprice"] if statements else []))
    if density != "sparse":
        j = j.repartition(n, "ticker")
    name = f"tickwise_rows_{uuid.uuid4().hex}"
    (j.sortWithinPartitions("ticker", "l_shipdate").write.option("path", shared_dir(spark, "rows-by-ticker"))
     .option("compression", "zstd").bucketBy(n, "ticker").saveAsTable(name))
    return typed_rows(spark.table(name))


def prices(rows: DataFrame) -> DataFrame:
    """Daily OHLCV per (ticker, date)."""
    # the first and the last line whole, so that their place is carried once each
    adjusted = F.col("px") * (F.lit(1.0) - F.col("l_discount"))
    return (rows.groupBy("ticker", F.col("d").alias("date"))
            .agg(F.min(F.struct("seq", "px")).alias("first"),
                 F.max("px").alias("high"),
                 F.min("px").alias("low"),
                 F.max(F.struct("seq", "px", adjusted.alias("adj"))).alias("last"),
                 F.sum("qty").cast("bigint").alias("volume"))
            .select("ticker", "date", F.col("first.px").alias("open"), "high", "low", F.col("last.px").alias("close"),
                    F.col("last.adj").alias("adjusted_close"), "volume", F.year("date").cast("bigint").alias("year")))


def _period_keys(period: str) -> list[Column]:
    y = F.year("d").cast("bigint")
    if period == "quarterly":
        end = quarter_end("d")
    elif period == "annual":
        end = F.make_date(F.year("d"), F.lit(12), F.lit(31))
    else:
        raise ValueError("period must be 'quarterly' or 'annual'")
    return [F.col("ticker"), y.alias("fiscal_year"), end.alias("fiscal_period")]


def _dbl(c: Column) -> Column:
    return c.cast("double")


def income(rows: DataFrame, period: str = "quarterly", with_eps: bool = False) -> DataFrame:
    """Income statement; ``with_eps`` adds reported EPS (= net income / shares)."""
    one = F.lit(1)
    rev = F.sum(F.col("ep") * (one - F.col("disc")))
    cogs = F.sum(F.col("qty") * F.col("rp"))
    ret = F.sum(F.when(F.col("rf") == "R", F.col("ep")).otherwise(F.lit(0).cast(MONEY)))
    taxes = F.sum(F.col("ep") * F.col("tax"))
    rd = F.sum(F.when(F.col("rf") == "A", -F.col("ep") * F.col("disc")))
    half = F.lit(Decimal("0.5"))
    aggs = [_dbl(rev).alias("revenue"),
            _dbl(rev - cogs).alias("gross_profit"),
            _dbl(rev - cogs - ret).alias("operating_income"),
            _dbl(rev - cogs - half * ret - taxes).alias("net_income"),
            _dbl(rd).alias("rd_expense")]
    if with_eps:
        shares = F.sum("p_size").cast("bigint") + F.lit(1000)
        aggs.append(F.try_divide(_dbl(rev - cogs - half * ret - taxes), shares).alias("eps"))
    return rows.groupBy(*_period_keys(period)).agg(*aggs)


def balance(rows: DataFrame, period: str = "quarterly") -> DataFrame:
    return (rows.groupBy(*_period_keys(period))
            .agg((F.sum("p_size").cast("bigint") + F.lit(1000)).alias("shares_outstanding")))


def cashflow(rows: DataFrame, period: str = "quarterly") -> DataFrame:
    """Cash flow statement; only linestatus 'F' rows, so some periods are missing."""
    one = F.lit(1)
    taxes = F.sum(F.col("ep") * F.col("tax"))
    return (rows.where(F.col("ls") == "F").groupBy(*_period_keys(period))
            .agg(_dbl(F.sum(F.col("ep") * (one - F.col("disc"))) - taxes)
                 .alias("operating_cash_flow"),
                 _dbl(-taxes).alias("capex")))


def combined(rows: DataFrame, period: str = "quarterly", with_eps: bool = False) -> DataFrame:
    one = F.lit(1)
    is_f = F.col("ls") == "F"
    rev = F.sum(F.col("ep") * (one - F.col("disc")))
    cogs = F.sum(F.col("qty") * F.col("rp"))
    ret = F.sum(F.when(F.col("rf") == "R", F.col("ep")).otherwise(F.lit(0).cast(MONEY)))
    taxes = F.sum(F.col("ep") * F.col("tax"))
    rd = F.sum(F.when(F.col("rf") == "A", -F.col("ep") * F.col("disc")))
    half = F.lit(Decimal("0.5"))
    ni = _dbl(rev - cogs - half * ret - taxes)
    shares = F.sum("p_size").cast("bigint") + F.lit(1000)
    f_rev = F.sum(F.when(is_f, F.col("ep") * (one - F.col("disc"))))
    f_tax = F.sum(F.when(is_f, F.col("ep") * F.col("tax")))
    aggs = [_dbl(rev).alias("revenue"), _dbl(rev - cogs).alias("gross_profit"),
            _dbl(rev - cogs - ret).alias("operating_income"), ni.alias("net_income"),
            _dbl(rd).alias("rd_expense")]
    if with_eps:
        aggs.append(F.try_divide(ni, shares).alias("eps"))
    aggs += [shares.alias("shares_outstanding"),
             _dbl(f_rev - f_tax).alias("operating_cash_flow"), _dbl(-f_tax).alias("capex")]
    return (rows.groupBy(*_period_keys(period)).agg(*aggs)
            .withColumn("free_cash_flow",
                        F.col("operating_cash_flow") - F.abs(F.col("capex"))))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company dimension keyed by the dense ticker."""
    pt = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand")
    num = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
    return (pt.select(ticker_expr("dense").alias("ticker"),
                      F.col("p_brand").alias("company_name"),
                      F.concat(F.lit("SEC"), F.pmod(num, F.lit(5)).cast("string")).alias("sector"))
            .distinct())


class Bridge:
    """All bridge tables for one (sf_dir, density); the joined rows are shared."""

    def __init__(self, spark: SparkSession, sf_dir: str, density: str = "dense"):
        self.spark, self.sf_dir, self.density = spark, sf_dir, density
        self.rows = line_rows(spark, sf_dir, density)

    def cache(self) -> "Bridge":
        """Keep the joined rows for several derived tables (like a downloaded extract)."""
        from pyspark import StorageLevel
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def by_ticker(self, statements: bool = True) -> "Bridge":
        """Keep the joined rows bucketed by ticker, for several derived tables that are grouped or joined by it."""
        self.rows = rows_by_ticker(self.spark, self.sf_dir, self.density, statements)
        return self

    def prices(self) -> DataFrame:
        return prices(self.rows)

    def income(self, period: str = "quarterly", with_eps: bool = False) -> DataFrame:
        return income(self.rows, period, with_eps)

    def balance(self, period: str = "quarterly") -> DataFrame:
        return balance(self.rows, period)

    def cashflow(self, period: str = "quarterly") -> DataFrame:
        return cashflow(self.rows, period)

    def companies(self) -> DataFrame:
        return companies(self.spark, self.sf_dir)

    def fundamentals(self, period: str = "quarterly", with_eps: bool = False) -> DataFrame:
        """Income, balance and cash flow combined (the stored fundamentals shape).

        One aggregation instead of three plus two joins: the cash-flow items
        are sums over linestatus 'F' rows only, so a period without such rows
        gets nulls, exactly as the left join of the separate statements does.
        """
        return combined(self.rows, period, with_eps)
