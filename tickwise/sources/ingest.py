"""Full and incremental ingestion from a vendor feed into a Store, plus summaries.

Both are single set-at-a-time jobs over all tickers (the reference loops over
tickers in Python).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tickwise.operators.ratios import ticker_names
from tickwise.operators.sets import resolve_universe, ticker_frame
from tickwise.operators.statements import combine_statements
from tickwise.schemas import DEFAULT_START_DATE, SAMPLE_UNIVERSE
from tickwise.session import ensure_checkpoint_dir
from tickwise.sources.extracts import (load_balance_extract, load_cashflow_extract, load_income_extract,
                                       load_prices_extract)
from tickwise.sources.store import Store


def _wanted(spark, tickers) -> DataFrame:
    tickers = ticker_names(tickers)
    return tickers.select("ticker").distinct() if isinstance(tickers, DataFrame) else ticker_frame(spark, tickers)


def _watched(write, *args) -> tuple[int, int]:
    """Rows stored and rows dropped (null or repeated keys) by a write, observed while it runs."""
    came, left = Observation(), Observation()
    if not write(*args, watch=(came, left)):
        return 0, came.get.get("n", 0)
    return left.get["n"], came.get["n"] - left.get["n"]


def ingest_full(store: Store, prices: DataFrame, quarterly: DataFrame | None = None,
                annual: DataFrame | None = None, tickers=None, start_date=None,
                include_fundamentals: bool = True) -> dict:
    """Write prices dated on/after ``start_date`` and both statement tables for
    the ticker list (default: every ticker of the price feed).

    Prices replace only the (ticker, year) slices present (D21); fundamentals
    replace whole tickers. Returns counts of tickers, of rows really stored, and of rows
    dropped for a null or repeated key (D13); ``errors`` says what had no data.
    """
    spark = store.spark
    start = F.lit(start_date or DEFAULT_START_DATE).cast("date")
    # the universe is evaluated once; a stored table also lets Spark split the joins with it
    ensure_checkpoint_dir(spark)
    wanted = (prices.select("ticker").where("ticker is not null").distinct() if tickers is None
              else _wanted(spark, tickers)).checkpoint()
    feed = prices if tickers is None else prices.join(wanted, "ticker", "left_semi")
    summary = {"tickers_processed": wanted.count(), "prices_written": 0, "fundamentals_written": 0,
               "rows_dropped": 0, "errors": []}
    with store.transaction():  # one commit for all tables, where the store has commits
        dated = feed.where(F.col("date").isNull() | (F.col("date") >= start))
        summary["prices_written"], summary["rows_dropped"] = _watched(store.write_prices, dated, None)
        if not summary["prices_written"]:
            summary["errors"].append("no price data")
        for period, df in (("quarterly", quarterly), ("annual", annual)):
            if df is None or not include_fundamentals:
                continue
            chosen = df.join(wanted, "ticker", "left_semi")
            written, dropped = _watched(store.write_fundamentals, chosen, period, None)
            summary["rows_dropped"] += dropped
            if period == "quarterly":
                summary["fundamentals_written"] = written
    return summary


def ingest_extracts(store: Store, prices: str, statements: dict[str, tuple], tickers=None, start_date=None,
                    fmt: str = "csv", sep: str = ";") -> dict:
    """From vendor files to stored tables in one call.

    ``statements`` maps a period (quarterly, annual) to the paths of its income, balance and cash
    flow extracts (None for one that is missing); they are combined before they are stored.
    """
    spark, frames = store.spark, {}
    for period, (income, balance, cashflow) in statements.items():
        loaded = [None if path is None else load(spark, path, fmt, sep, period=period) for load, path in (
            (load_income_extract, income), (load_balance_extract, balance), (load_cashflow_extract, cashflow))]
        frames[period] = combine_statements(*loaded)
    return ingest_full(store, load_prices_extract(spark, prices, fmt, sep), frames.get("quarterly"),
                       frames.get("annual"), tickers, start_date)


def sample_universe(feed: DataFrame) -> DataFrame:
    """The fixed large-company sample as far as the feed has it, aliases included."""
    return resolve_universe(ticker_frame(feed.sparkSession, SAMPLE_UNIVERSE), feed)


def incremental_rows(stored_prices: DataFrame, feed: DataFrame, tickers=None) -> DataFrame:
    """Feed rows dated after each stored ticker's newest date; tickers with
    nothing stored are skipped (strict late rule: rows at or before the stored
    max are ignored).

    The per-ticker maxima are stored before the join: both sides are then plain
    shuffles and AQE can split a ticker that holds much of the feed.
    """
    stored = stored_prices
    if tickers is not None:
        stored = stored.join(_wanted(stored.sparkSession, tickers), "ticker", "left_semi")
    ensure_checkpoint_dir(stored.sparkSession)
    last = stored.groupBy("ticker").agg(F.max("date").alias("_max_date")).checkpoint()
    return (feed.join(last, "ticker").where(F.col("date") > F.col("_max_date"))
            .drop("_max_date"))


def ingest_incremental(store: Store, feed: DataFrame, tickers=None) -> dict:
    """Append the rows of ``incremental_rows``; the upsert stages them before it touches the table."""
    new = incremental_rows(store.read("prices").drop("ticker_bucket"), feed, tickers)
    with store._staged(new) as staged:
        counts = staged.agg(F.countDistinct("ticker").alias("t"), F.count(F.lit(1)).alias("n")).first()
        if counts["n"]:
            store.append_prices(staged)
    return {"tickers_updated": counts["t"], "new_records": counts["n"]}


def has_data(tickers: DataFrame, prices: DataFrame, quarterly: DataFrame,
             annual: DataFrame) -> DataFrame:
    """(ticker, prices, quarterly, annual): does each table hold rows for the ticker."""
    out = tickers.select("ticker").distinct()
    for name, df in (("prices", prices), ("quarterly", quarterly), ("annual", annual)):
        present = df.select("ticker").distinct().withColumn(name, F.lit(True))
        out = out.join(present, "ticker", "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(False)))
    return out


def data_summary(prices: DataFrame, quarterly: DataFrame, annual: DataFrame,
                 sample: int = 5) -> DataFrame:
    """Distinct-ticker counts of the three tables with the date ranges of the
    first ``sample`` tickers (one row per sample ticker)."""
    first = prices.select("ticker").distinct().orderBy("ticker").limit(sample)
    ranges = (prices.join(first, "ticker", "left_semi").groupBy("ticker")
              .agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("min_date"),
                   F.date_format(F.max("date"), "yyyy-MM-dd").alias("max_date")))
    # table-wide counts as scalar subqueries next to the per-ticker rows
    return prices.sparkSession.sql("""SELECT r.*,
  (SELECT count(DISTINCT ticker) FROM {p}) AS price_tickers,
  (SELECT count(DISTINCT ticker) FROM {q}) AS quarterly_tickers,
  (SELECT count(DISTINCT ticker) FROM {a}) AS annual_tickers
FROM {r} r""", p=prices, q=quarterly, a=annual, r=ranges)
