"""Data-quality checks over the stored (or extracted) tables.

Each check is a small aggregate returning one row (or one row per required
ticker); ``quality_report`` unions them in order. Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators.sets import ticker_frame

KEY_INCOME_COLUMNS = ["revenue", "net_income", "gross_profit", "operating_income"]


def _required(spark: SparkSession, required) -> DataFrame:
    return required if isinstance(required, DataFrame) else ticker_frame(spark, required)


def coverage_check(companies: DataFrame, required) -> DataFrame:
    """(ticker, found) for each required ticker against the company table."""
    req = _required(companies.sparkSession, required)
    found = companies.select("ticker").distinct().withColumn("found", F.lit(True))
    return (req.join(found, "ticker", "left")
            .select("ticker", F.coalesce("found", F.lit(False)).alias("found")))


def price_profile(prices: DataFrame, ref_ticker: str, cutoff: str = "2020-06-01") -> DataFrame:
    """Rows, tickers, date span, the reference ticker's rows/span; pass if history
    starts on or before ``cutoff``."""
    is_ref = F.col("ticker") == F.lit(ref_ticker)
    return prices.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
        F.countDistinct("ticker").cast("bigint").alias("unique_tickers"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.count_if(is_ref).cast("bigint").alias("ref_rows"),
        F.min(F.when(is_ref, F.col("date"))).alias("ref_min_date"),
        F.max(F.when(is_ref, F.col("date"))).alias("ref_max_date"),
    ).withColumn("passed", F.coalesce(F.col("min_date") <= F.lit(cutoff).cast("date"),
                                      F.lit(False)))


def fundamentals_profile(income: DataFrame, ref_ticker: str) -> DataFrame:
    """Rows, tickers, reference ticker's quarters, key columns present (pass if >= 2 of 4)."""
    found = [c for c in KEY_INCOME_COLUMNS if c in income.columns]
    return income.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rows"),
        F.countDistinct("ticker").cast("bigint").alias("unique_tickers"),
        F.count_if(F.col("ticker") == F.lit(ref_ticker)).cast("bigint").alias("ref_quarters"),
    ).select("*", F.lit(len(found)).cast("bigint").alias("key_columns_found"),
             F.lit(len(found) >= 2).alias("passed"))


def completeness_by_ticker(prices: DataFrame, income: DataFrame, required) -> DataFrame:
    """Per required ticker: price rows and statement rows (0 when absent)."""
    req = _required(prices.sparkSession, required)
    pc = prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("price_rows"))
    ic = income.groupBy("ticker").agg(F.count(F.lit(1)).alias("income_quarters"))
    out = (req.join(pc, "ticker", "left").join(ic, "ticker", "left")
           .select("ticker",
                   F.coalesce("price_rows", F.lit(0)).cast("bigint").alias("price_rows"),
                   F.coalesce("income_quarters", F.lit(0)).cast("bigint").alias("income_quarters")))
    return out.withColumn("complete", (F.col("price_rows") > 0) & (F.col("income_quarters") > 0))


def _name_match(cols, needles) -> list[str]:
    return [c for c in cols if any(n in c.lower() for n in needles)]


def rd_capex_availability(cashflow: DataFrame, income: DataFrame) -> DataFrame:
    """Are CapEx / R&D columns present (by name), and how often are they filled."""
    capex_cols = _name_match(cashflow.columns, ("fixed assets", "capex"))
    rd_cols = _name_match(income.columns, ("r&d", "research", "rd_expense"))

    def share(cols) -> str:
        if not cols:
            return "CAST(NULL AS DOUBLE)"
        return f"try_divide(count(`{cols[0]}`), count(1))"

    # two single-row aggregates side by side as scalar subqueries (no join)
    return cashflow.sparkSession.sql(
        f"""SELECT {bool(capex_cols)} AS capex_available, {bool(rd_cols)} AS rd_available,
  (SELECT {share(capex_cols)} FROM {{cf}}) AS capex_filled_share,
  (SELECT {share(rd_cols)} FROM {{inc}}) AS rd_filled_share,
  {bool(capex_cols)} AS passed""", cf=cashflow, inc=income)


def quality_report(companies: DataFrame, prices: DataFrame, income: DataFrame,
                   cashflow: DataFrame, required, ref_ticker: str,
                   cutoff: str = "2020-06-01") -> DataFrame:
    """All checks in order as (step, check, passed, message), then an overall row.

    Later steps are dropped when the first one (company table loads) fails;
    overall = AND of the reported steps.
    """
    comp = companies.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("step"), F.lit("Company table").alias("check"),
        (F.col("n") > 0).alias("passed"),
        F.format_string("loaded %d companies", F.col("n")).alias("message"))
    cov = coverage_check(companies, required).agg(
        F.count_if("found").alias("f"), F.count(F.lit(1)).alias("n")).select(
        F.lit(2).alias("step"), F.lit("Coverage").alias("check"),
        (F.col("f") >= F.least(F.lit(4), F.col("n"))).alias("passed"),
        F.format_string("found %d/%d required tickers", F.col("f"), F.col("n")).alias("message"))
    pp = price_profile(prices, ref_ticker, cutoff).select(
        F.lit(3).alias("step"), F.lit("Price data").alias("check"), "passed",
        F.format_string("%d rows, %d tickers", "total_rows", "unique_tickers").alias("message"))
    fp = fundamentals_profile(income, ref_ticker).select(
        F.lit(4).alias("step"), F.lit("Fundamentals data").alias("check"), "passed",
        F.format_string("%d rows, %d tickers", "total_rows", "unique_tickers").alias("message"))
    cb = completeness_by_ticker(prices, income, required).agg(
        F.count_if("complete").alias("c"), F.count(F.lit(1)).alias("n")).select(
        F.lit(5).alias("step"), F.lit("Data completeness").alias("check"),
        (F.col("c") >= F.lit(3)).alias("passed"),
        F.format_string("%d/%d required tickers have complete data", "c", "n").alias("message"))
    rc = rd_capex_availability(cashflow, income).select(
        F.lit(6).alias("step"), F.lit("R&D and CapEx data").alias("check"), "passed",
        F.concat(F.lit("CapEx: "), F.when(F.col("capex_available"), "Available").otherwise("Not found"),
                 F.lit(", R&D: "), F.when(F.col("rd_available"), "Available").otherwise("Not found"))
        .alias("message"))
    steps = reduce(DataFrame.unionByName, [comp, cov, pp, fp, cb, rc])
    # later steps only when the first passed; overall = AND of what is reported
    return companies.sparkSession.sql("""WITH s AS (
  SELECT CAST(step AS BIGINT) AS step, `check`, passed, message FROM {steps}
  WHERE step = 1 OR (SELECT first(passed) FROM {steps} WHERE step = 1))
SELECT * FROM s
UNION ALL
SELECT 99, 'Overall', bool_and(passed), CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'FAILED' END
FROM s""", steps=steps)
