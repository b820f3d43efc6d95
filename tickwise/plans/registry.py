"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables through the bridge (so its work grows
with the scale factor) and has a DuckDB SQL twin in ``SQL``. Sink queries
write to a fresh folder under the session's checkpoint directory and return
the table read back, so their twin is plain SQL over the sources.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.functions import scalar as S
from tickwise.operators import filters as FL
from tickwise.operators import metrics as M
from tickwise.operators import prices as P
from tickwise.operators import quality as Q
from tickwise.operators import ratios as R
from tickwise.operators import sets as ST
from tickwise.operators import ttm as T
from tickwise.plans import datasets as D
from tickwise.plans import oracle as O
from tickwise.session import shared_dir
from tickwise.sources import extracts as X
from tickwise.sources import ingest as I
from tickwise.sources.bridge import Bridge
from tickwise.sources.catalog import CatalogStore
from tickwise.sources.maintained import MaintainedStore
from tickwise.sources.profiled import ProfiledStore
from tickwise.sources.store import Store
from tickwise.sources.versioned import VersionedStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Query parameters (not data subsets: every query still reads whole tables).
AS_OF = "1999-12-31"
DENSE_PANEL_DATES = [(dt.date(1995, 6, 30) + dt.timedelta(days=11 * i)).isoformat() for i in range(200)]
PANEL_DATES = ["1995-06-30", "1995-12-31", "1997-03-31", "1999-12-31", "2001-11-30"]
REQUIRED = ["B1", "B7", "B13", "B25", "ZZZ"]
REF_TICKER = "B7"
CUT = "1998-06-30"
W = O.with_bridge


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _b(spark, sf_dir, density="dense") -> Bridge:
    return Bridge(spark, sf_dir, density)


def _store(spark, name) -> Store:
    return Store(spark, shared_dir(spark, f"store-{name}"))


def _catalog_store(spark, sf_dir, name, density) -> CatalogStore:
    """Prices and quarterly statements as tables bucketed by ticker."""
    st, b = CatalogStore(spark, shared_dir(spark, f"catalog-{name}")), _b(spark, sf_dir, density).by_ticker()
    st.write_prices(b.prices(), clustered=True)
    st.write_fundamentals(b.fundamentals(), "quarterly", clustered=True)
    return st


def _ratios(spark, sf_dir, density, **kw) -> DataFrame:
    b = _b(spark, sf_dir, density)
    return R.ratio_table(b.prices(), b.fundamentals(), **kw)


def _companies_plus(spark, sf_dir, extra=("ZZZ",)) -> DataFrame:
    c = _b(spark, sf_dir).companies().select("ticker")
    return c.unionByName(ST.ticker_frame(spark, list(extra)))


_UNIVERSE_PLUS = "SELECT ticker FROM companies UNION SELECT 'ZZZ'"
_REQ_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in REQUIRED) + ") r(ticker)"
_PCOLS = "ticker, date, open, high, low, close, adjusted_close, volume, year"


# =========================================================================== 2.1 scans / sources
@register("scan_prices", W("SELECT ticker, date, close, volume FROM prices "
                           "WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'", "sparse"))
def q_scan_prices(spark, sf_dir):
    st = _store(spark, "scan_prices")
    st.write_prices(_b(spark, sf_dir, "sparse").prices())
    return st.scan_prices(start_date="1997-01-01", end_date="1999-12-31",
                          columns=["close", "volume", "no_such_column"])


@register("scan_fundamentals_quarterly",
          W("SELECT ticker, revenue, net_income FROM fund_q", "medium"))
def q_scan_fq(spark, sf_dir):
    st = _store(spark, "scan_fq")
    st.write_fundamentals(_b(spark, sf_dir, "medium").fundamentals(), "quarterly")
    return st.scan_fundamentals_quarterly(columns=["revenue", "net_income"])


@register("scan_fundamentals_annual", W("SELECT * FROM fund_a"))
def q_scan_fa(spark, sf_dir):
    st = _store(spark, "scan_fa")
    st.write_fundamentals(_b(spark, sf_dir).fundamentals("annual"), "annual")
    return st.scan_fundamentals_annual()


@register("read_metadata", W("SELECT * FROM companies"))
def q_read_metadata(spark, sf_dir):
    st = _store(spark, "read_metadata")
    st.write_metadata(_b(spark, sf_dir).companies(), "companies")
    return st.read_metadata("companies")


@register("scan_empty_table",
          W("SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS quarterly_rows FROM prices"))
def q_scan_empty(spark, sf_dir):
    st = _store(spark, "scan_empty")
    st.write_prices(_b(spark, sf_dir).prices())
    q = st.scan_fundamentals_quarterly()           # never written: empty, with schema
    counts = q.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return (st.list_tickers("prices").join(counts, "ticker", "left")
            .select("ticker", F.coalesce("n", F.lit(0)).cast("bigint").alias("quarterly_rows")))


def _vendor_csv(df: DataFrame, mapping: dict, path: str, extra: dict | None = None, compression: str = "none") -> str:
    inverse = {v: k for k, v in mapping.items() if k != "research_development"}
    out = df
    for c, e in (extra or {}).items():
        out = out.withColumn(c, e)
    out = out.select(*[F.col(c).alias(inverse.get(c, c)) for c in out.columns])
    out.write.mode("overwrite").option("header", "true").option("sep", ";").option("compression", compression).csv(path)
    return path


@register("load_prices_extract", W(
    "SELECT ticker, date, open, high, low, close, adjusted_close, volume FROM prices"))
def q_load_prices(spark, sf_dir):
    from tickwise.schemas import PRICE_COLUMN_MAP
    path = _vendor_csv(_b(spark, sf_dir).prices().drop("year"), PRICE_COLUMN_MAP,
                       shared_dir(spark, "vendor-prices"))
    return X.load_prices_extract(spark, path)


# faults put into a price file, by volume: an unreadable day, an unreadable close, no ticker
_FAULTS = {7: ("date", "31.31.1997"), 8: ("close", "n/a"), 9: ("ticker", None)}


def _faulty_prices(spark, sf_dir, name) -> X.Loaded:
    from tickwise.schemas import PRICE_COLUMN_MAP
    px = _b(spark, sf_dir, "sparse").prices().drop("year")
    as_text = px.select(*[F.col(c).cast("string").alias(c) for c in px.columns], (F.col("volume") % 50).alias("_k"))
    for k, (c, value) in _FAULTS.items():
        as_text = as_text.withColumn(c, F.when(F.col("_k") == k, F.lit(value)).otherwise(F.col(c)))
    path = _vendor_csv(as_text.drop("_k"), PRICE_COLUMN_MAP, shared_dir(spark, f"faulty-{name}"))
    return X.load_with_rejects(spark, path, "prices", shared_dir(spark, f"loaded-{name}"))


@register("load_prices_good_rows", W("SELECT ticker, date, open, high, low, close, adjusted_close, volume FROM prices "
                                     "WHERE volume % 50 NOT IN (7, 8, 9)", "sparse"))
def q_load_good(spark, sf_dir):
    """Good rows of a price file with faulty ones; the faulty are kept apart in the same reading."""
    return _faulty_prices(spark, sf_dir, "good").rows


@register("load_prices_rejects", W(
    "SELECT CASE volume % 50 WHEN 7 THEN 'date: malformed' WHEN 8 THEN 'close: malformed' ELSE 'ticker: missing' END AS reason, "
    "count(*) AS n, max(close) FILTER (WHERE volume % 50 <> 8) AS close FROM prices WHERE volume % 50 IN (7, 8, 9) "
    "GROUP BY 1", "sparse"))
def q_load_rejects(spark, sf_dir):
    from tickwise.schemas import PRICE_COLUMN_MAP
    vendor = {v: k for k, v in PRICE_COLUMN_MAP.items()}
    rejects = _faulty_prices(spark, sf_dir, "rejects").rejects
    close = F.get_json_object("raw", f"$['{vendor.get('close', 'close')}']").try_cast("double")
    return rejects.groupBy(F.element_at("reasons", 1).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.max(close).alias("close"))


_LABEL = "'Q' || CAST(quarter(fiscal_period) AS VARCHAR) AS fiscal_label"


@register("load_income_extract", W(f"SELECT *, {_LABEL} FROM income_q", "medium"))
def q_load_income(spark, sf_dir):
    from tickwise.schemas import INCOME_COLUMN_MAP
    inc = _b(spark, sf_dir, "medium").income()
    path = _vendor_csv(inc, INCOME_COLUMN_MAP, shared_dir(spark, "vendor-income"),
                       {"fiscal_label": F.concat(F.lit("Q"), F.quarter("fiscal_period")
                                                 .cast("string"))})
    return X.load_income_extract(spark, path)


@register("load_balance_extract", W(f"SELECT *, {_LABEL} FROM balance_q", "medium"))
def q_load_balance(spark, sf_dir):
    from tickwise.schemas import BALANCE_COLUMN_MAP
    bal = _b(spark, sf_dir, "medium").balance()
    path = _vendor_csv(bal, BALANCE_COLUMN_MAP, shared_dir(spark, "vendor-balance"),
                       {"fiscal_label": F.concat(F.lit("Q"), F.quarter("fiscal_period")
                                                 .cast("string"))})
    return X.load_balance_extract(spark, path)


@register("load_cashflow_extract", W(f"SELECT *, {_LABEL} FROM cashflow_q", "medium"))
def q_load_cashflow(spark, sf_dir):
    from tickwise.schemas import CASHFLOW_COLUMN_MAP
    cf = _b(spark, sf_dir, "medium").cashflow()
    path = _vendor_csv(cf, CASHFLOW_COLUMN_MAP, shared_dir(spark, "vendor-cashflow"),
                       {"fiscal_label": F.concat(F.lit("Q"), F.quarter("fiscal_period")
                                                 .cast("string"))})
    return X.load_cashflow_extract(spark, path)


@register("load_companies_extract", W("SELECT * FROM companies"))
def q_load_companies(spark, sf_dir):
    path = _vendor_csv(_b(spark, sf_dir).companies(), {"Ticker": "ticker"},
                       shared_dir(spark, "vendor-companies"))
    return X.load_companies_extract(spark, path)


# =========================================================================== 2.2 sinks
@register("write_prices", W(
    "SELECT ticker, date, open, high, low, CASE WHEN year = 1999 THEN close + 1 ELSE close END "
    "AS close, adjusted_close, volume, year FROM prices", "sparse"))
def q_write_prices(spark, sf_dir):
    st = _store(spark, "write_prices")
    px = _b(spark, sf_dir, "sparse").prices()
    st.write_prices(px)
    st.write_prices(px.where(F.col("year") == 1999).withColumn("close", F.col("close") + 1))
    return st.scan_prices()


_REPLACED = ("SELECT * FROM {t} WHERE fiscal_year >= 2000 OR ticker NOT IN "
             "(SELECT ticker FROM {t} WHERE fiscal_year >= 2000)")


@register("write_fundamentals_quarterly", W(_REPLACED.format(t="fund_q"), "medium"))
def q_write_fq(spark, sf_dir):
    st = _store(spark, "write_fq")
    fq = _b(spark, sf_dir, "medium").fundamentals()
    st.write_fundamentals_quarterly(fq)
    st.write_fundamentals_quarterly(fq.where(F.col("fiscal_year") >= 2000))
    return st.scan_fundamentals_quarterly()


@register("write_fundamentals_annual", W(_REPLACED.format(t="fund_a")))
def q_write_fa(spark, sf_dir):
    st = _store(spark, "write_fa")
    fa = _b(spark, sf_dir).fundamentals("annual")
    st.write_fundamentals_annual(fa)
    st.write_fundamentals_annual(fa.where(F.col("fiscal_year") >= 2000))
    return st.scan_fundamentals_annual()


@register("write_metadata", W("SELECT ticker, lower(company_name) AS company_name, sector "
                              "FROM companies"))
def q_write_metadata(spark, sf_dir):
    st = _store(spark, "write_metadata")
    c = _b(spark, sf_dir).companies()
    st.write_metadata(c, "companies")
    st.write_metadata(c.withColumn("company_name", F.lower("company_name")), "companies")
    return st.read_metadata("companies")


# split of prices at a per-ticker cut day: stored rows up to it, a feed from it on
_CUTS = f"cuts AS (SELECT ticker, max(date) AS cut FROM prices WHERE date <= DATE '{CUT}' GROUP BY ticker)"


def _split(px: DataFrame):
    cuts = (px.where(F.col("date") <= F.lit(CUT).cast("date"))
            .groupBy("ticker").agg(F.max("date").alias("cut")))
    j = px.join(cuts, "ticker", "left")
    stored = j.where(F.col("date") <= F.col("cut")).drop("cut")
    feed = (j.where(F.col("cut").isNull() | (F.col("date") >= F.col("cut")))
            .withColumn("close", F.when(F.col("date") == F.col("cut"), F.col("close") + 1)
                        .otherwise(F.col("close"))).drop("cut"))
    return stored, feed


@register("append_prices", W(
    "SELECT p.ticker, p.date, p.open, p.high, p.low, CASE WHEN p.date = c.cut THEN p.close + 1 "
    "ELSE p.close END AS close, p.adjusted_close, p.volume, p.year "
    "FROM prices p LEFT JOIN cuts c USING (ticker)", density="sparse", extra=_CUTS))
def q_append_prices(spark, sf_dir):
    st = _store(spark, "append_prices")
    stored, feed = _split(_b(spark, sf_dir, "sparse").by_ticker(False).prices())
    st.write_prices(stored, clustered=True)
    st.append_prices(feed, clustered=True)
    return st.scan_prices()


@register("append_prices_versioned", W(
    "SELECT p.ticker, p.date, p.open, p.high, p.low, CASE WHEN p.date = c.cut THEN p.close + 1 "
    "ELSE p.close END AS close, p.adjusted_close, p.volume, p.year "
    "FROM prices p LEFT JOIN cuts c USING (ticker) WHERE p.ticker NOT LIKE 'P%0'", density="sparse", extra=_CUTS))
def q_append_versioned(spark, sf_dir):
    """The upsert and a deletion as file-level rewrites under one commit log."""
    st = VersionedStore(spark, shared_dir(spark, "store-versioned"))
    px = _b(spark, sf_dir, "sparse").by_ticker(False).prices()
    stored, feed = _split(px)
    st.write_prices(stored, clustered=True)
    with st.transaction():
        st.append_prices(feed, clustered=True)
        st.delete_ticker(px.select("ticker").where("ticker LIKE 'P%0'"))
    return st.scan_prices()


@register("append_prices_last_in_files", W(
    "SELECT p.ticker, p.date, p.open, p.high, p.low, CASE WHEN p.date = c.cut THEN p.close + 1 "
    "ELSE p.close END AS close, p.adjusted_close, p.volume, p.year "
    "FROM prices p LEFT JOIN cuts c USING (ticker)", density="sparse", extra=_CUTS))
def q_append_last_in_files(spark, sf_dir):
    """One batch of files that holds every key of the feed twice: what stands last in the files is stored."""
    st = _store(spark, "append_last")
    stored, feed = _split(_b(spark, sf_dir, "sparse").by_ticker(False).prices())
    st.write_prices(stored, clustered=True)
    batch = shared_dir(spark, "feed-twice")
    feed.withColumn("close", F.col("close") + 1000).write.parquet(f"{batch}/1-early")
    feed.write.parquet(f"{batch}/2-late")
    st.append_prices(spark.read.schema(feed.schema).option("recursiveFileLookup", "true").parquet(batch))
    return st.scan_prices()


@register("stream_upsert", W(
    "SELECT p.ticker, p.date, p.open, p.high, p.low, CASE WHEN p.date = c.cut THEN p.close + 1 "
    "ELSE p.close END AS close, p.adjusted_close, p.volume, p.year "
    "FROM prices p LEFT JOIN cuts c USING (ticker)", density="sparse", extra=_CUTS))
def q_stream_upsert(spark, sf_dir):
    """The append_prices result, with the feed arriving as files drained by a stream."""
    from tickwise.streaming.upsert import start_price_upsert
    st = _store(spark, "stream_upsert")
    stored, feed = _split(_b(spark, sf_dir, "sparse").by_ticker(False).prices())
    st.write_prices(stored, clustered=True)
    feed_dir = shared_dir(spark, "stream-feed")
    feed.write.mode("overwrite").parquet(feed_dir)
    q = start_price_upsert(spark, st, feed_dir, shared_dir(spark, "stream-ckpt"))
    q.awaitTermination()
    st.refresh()
    return st.scan_prices()


@register("ingest_incremental", W(
    f"SELECT {_PCOLS} FROM prices WHERE ticker IN (SELECT ticker FROM cuts)", density="sparse", extra=_CUTS))
def q_ingest_incremental(spark, sf_dir):
    st = _store(spark, "ingest_incremental")
    stored, feed = _split(_b(spark, sf_dir, "sparse").by_ticker(False).prices())
    st.write_prices(stored, clustered=True)
    I.ingest_incremental(st, feed)
    return st.scan_prices()


def _incremental_stream(spark, sf_dir, name):
    """The feed of ingest_incremental as files, older days first; the stream is stopped in between and started again."""
    from tickwise.streaming.incremental import IncrementalStream
    st = _store(spark, f"stream-{name}")
    stored, feed = _split(_b(spark, sf_dir, "sparse").by_ticker(False).prices())
    st.write_prices(stored, clustered=True)
    feed_dir = shared_dir(spark, f"late-feed-{name}")
    stream = IncrementalStream(spark, st, feed_dir, shared_dir(spark, f"late-work-{name}"), schema=feed.schema)
    for part in ("year < 2000", "year >= 2000"):
        feed.where(part).write.mode("append").parquet(feed_dir)
        stream.start().awaitTermination()
    st.refresh()
    return st, stream


@register("stream_incremental", W(
    f"SELECT {_PCOLS} FROM prices WHERE ticker IN (SELECT ticker FROM cuts)", density="sparse", extra=_CUTS))
def q_stream_incremental(spark, sf_dir):
    return _incremental_stream(spark, sf_dir, "rows")[0].scan_prices()


@register("stream_late_rows", W(
    "SELECT p.ticker, p.date, CASE WHEN p.date = c.cut THEN p.close + 1 ELSE p.close END AS close, c.cut AS late_for, "
    "CASE WHEN c.cut IS NULL THEN 'unknown ticker' ELSE 'late' END AS reason "
    "FROM prices p LEFT JOIN cuts c USING (ticker) WHERE c.cut IS NULL OR p.date = c.cut", density="sparse", extra=_CUTS))
def q_stream_late(spark, sf_dir):
    """Feed rows that came too late, or whose ticker nothing is stored of."""
    return _incremental_stream(spark, sf_dir, "late")[1].late_rows().select("ticker", "date", "close", "late_for", "reason")


@register("delete_ticker", W(
    f"SELECT {_PCOLS}, 3 AS tables_affected FROM prices WHERE ticker NOT LIKE 'P%0'", "sparse"))
def q_delete_ticker(spark, sf_dir):
    st = _store(spark, "delete_ticker")
    b = _b(spark, sf_dir, "sparse").by_ticker()
    st.write_prices(b.prices(), clustered=True)
    st.write_fundamentals(b.fundamentals(), "quarterly", clustered=True)
    st.write_fundamentals(b.fundamentals("annual"), "annual", clustered=True)
    n = st.delete_ticker(b.prices().select("ticker").where("ticker LIKE 'P%0'"))
    return st.scan_prices().withColumn("tables_affected", F.lit(n))


@register("write_prices_repeated", W(f"SELECT {_PCOLS} FROM prices", "sparse"))
def q_write_prices_repeated(spark, sf_dir):
    """A batch that holds every (ticker, date) twice is stored once."""
    st = _store(spark, "write_prices_repeated")
    px = _b(spark, sf_dir, "sparse").prices()
    st.write_prices(px.unionByName(px))
    return st.scan_prices()


@register("ticker_layout_numeric", W(
    f"SELECT replace(ticker, 'B', '1E') AS ticker, {_PCOLS.partition(', ')[2]} FROM prices"))
def q_ticker_layout_numeric(spark, sf_dir):
    """Tickers that look like numbers (1E12) stay strings in the one-folder-per-ticker layout."""
    st = Store(spark, shared_dir(spark, "store-ticker_layout"), layout="ticker")
    st.write_prices(_b(spark, sf_dir).prices().withColumn("ticker", F.replace("ticker", F.lit("B"), F.lit("1E"))))
    st.refresh()
    return st.scan_prices()


@register("table_keeps_its_buckets", W(f"SELECT {_PCOLS} FROM prices WHERE ticker IN ('P1', 'P7', 'P13', 'P200')",
                                       "sparse"))
def q_table_keeps_its_buckets(spark, sf_dir):
    """A table of 24 buckets is read by a Store whose own number differs."""
    root = shared_dir(spark, "store-buckets")
    Store(spark, root, buckets=24).write_prices(_b(spark, sf_dir, "sparse").prices())
    return Store(spark, root).scan_prices(ticker=["P1", "P7", "P13", "P200"])


def _vendor_statements(spark, b: Bridge, period: str) -> tuple[str, ...]:
    """Income, balance and cash flow extracts of one period, as the vendor writes them."""
    from tickwise.schemas import BALANCE_COLUMN_MAP, CASHFLOW_COLUMN_MAP, INCOME_COLUMN_MAP
    label = (F.lit("FY") if period == "annual"
             else F.concat(F.lit("Q"), F.quarter("fiscal_period").cast("string")))
    frames = ((b.income(period), INCOME_COLUMN_MAP), (b.balance(period), BALANCE_COLUMN_MAP),
              (b.cashflow(period), CASHFLOW_COLUMN_MAP))
    return tuple(_vendor_csv(df, columns, shared_dir(spark, f"vendor-{period}-{i}"), {"fiscal_label": label}, "gzip")
                 for i, (df, columns) in enumerate(frames))


@register("ingest_full", W("""SELECT
  (SELECT count(DISTINCT ticker) FROM prices) AS tickers_processed,
  (SELECT count(*) FROM prices WHERE date >= DATE '1997-01-01') AS prices_written,
  (SELECT count(*) FROM fund_q) AS fundamentals_written,
  (SELECT count(*) FROM prices WHERE year IN (1997, 1998)) AS rows_dropped,
  (SELECT count(*) FROM prices WHERE date >= DATE '1997-01-01') AS stored_price_rows,
  (SELECT count(*) FROM fund_q) AS stored_quarterly_rows,
  (SELECT count(*) FROM fund_a) AS stored_annual_rows""", "medium"))
def q_ingest_full(spark, sf_dir):
    """Vendor files (gzip) to tables; the price file repeats 1998 and has 1997 once more without tickers."""
    from tickwise.schemas import PRICE_COLUMN_MAP
    st = _store(spark, "ingest_full")
    b = _b(spark, sf_dir, "medium").by_ticker()
    px = b.prices()
    dirty = (px.unionByName(px.where("year = 1998"))
             .unionByName(px.where("year = 1997").withColumn("ticker", F.lit(None).cast("string"))))
    s = I.ingest_extracts(st, _vendor_csv(dirty.drop("year"), PRICE_COLUMN_MAP, shared_dir(spark, "vendor-px"), None, "gzip"),
                          {p: _vendor_statements(spark, b, p) for p in ("quarterly", "annual")},
                          start_date="1997-01-01")
    return spark.sql(
        """SELECT CAST(:t AS BIGINT) AS tickers_processed, CAST(:p AS BIGINT) AS prices_written,
  CAST(:f AS BIGINT) AS fundamentals_written, CAST(:d AS BIGINT) AS rows_dropped,
  (SELECT count(1) FROM {sp}) AS stored_price_rows,
  (SELECT count(1) FROM {sq}) AS stored_quarterly_rows,
  (SELECT count(1) FROM {sa}) AS stored_annual_rows""",
        args={"t": s["tickers_processed"], "p": s["prices_written"], "f": s["fundamentals_written"],
              "d": s["rows_dropped"]},
        sp=st.read("prices"), sq=st.read("quarterly"), sa=st.read("annual"))


@register("ingest_full_one_commit", W("""SELECT 1 AS version,
  (SELECT count(*) FROM prices WHERE date >= DATE '1997-01-01') AS stored_price_rows,
  (SELECT count(*) FROM fund_q) AS stored_quarterly_rows,
  (SELECT count(*) FROM fund_a) AS stored_annual_rows""", "medium"))
def q_ingest_one_commit(spark, sf_dir):
    """Three tables in one version; a second update that stops between two of them leaves the first in place."""
    st, b = VersionedStore(spark, shared_dir(spark, "store-one-commit")), _b(spark, sf_dir, "medium")
    I.ingest_full(st, b.prices(), b.fundamentals(), b.fundamentals("annual"), start_date="1997-01-01")
    try:
        I.ingest_full(st, b.prices().withColumn("close", F.lit(0.0)), b.fundamentals().limit(5),
                      b.fundamentals("annual").withColumn("fiscal_period", F.raise_error(F.lit("stop")).cast("date")))
    except Exception as e:  # noqa: BLE001 - the stop asked for above
        if "stop" not in str(e):
            raise
    seen = VersionedStore(spark, st.root)
    return spark.sql("""SELECT CAST(:v AS INT) AS version, (SELECT count(1) FROM {p} WHERE close > 0) AS stored_price_rows,
  (SELECT count(1) FROM {q}) AS stored_quarterly_rows, (SELECT count(1) FROM {a}) AS stored_annual_rows""",
                     args={"v": seen.versions()[-1]}, p=seen.read("prices"), q=seen.read("quarterly"), a=seen.read("annual"))


# =========================================================================== 2.3 filters
@register("filter_ticker", W(f"SELECT * FROM prices WHERE ticker = '{REF_TICKER}'"))
def q_filter_ticker(spark, sf_dir):
    return FL.filter_ticker(_b(spark, sf_dir).prices(), REF_TICKER)


@register("filter_date_range", W("SELECT * FROM prices WHERE date BETWEEN DATE '1998-01-01' "
                                 "AND DATE '1998-12-31'", "sparse"))
def q_filter_date_range(spark, sf_dir):
    return FL.filter_date_range(_b(spark, sf_dir, "sparse").prices(), "1998-01-01", "1998-12-31")


@register("filter_as_of", W("SELECT * FROM fund_q WHERE fiscal_period <= DATE '1998-12-31'",
                            "sparse"))
def q_filter_as_of(spark, sf_dir):
    return FL.filter_as_of(_b(spark, sf_dir, "sparse").fundamentals(), "1998-12-31")


@register("project_columns", W("SELECT ticker, date, volume, close FROM prices", "medium"))
def q_project_columns(spark, sf_dir):
    return FL.project_columns(_b(spark, sf_dir, "medium").prices(),
                              ["volume", "close", "no_such_column"])


@register("screen_stocks", O.ratio_table_sql(
    "sparse", final="SELECT * FROM ratios WHERE pe_ratio >= 0 AND pe_ratio <= 25 "
                    "AND operating_margin >= 0.1"))
def q_screen(spark, sf_dir):
    return FL.screen_stocks(_ratios(spark, sf_dir, "sparse"),
                            {"pe_ratio": (0, 25), "operating_margin": (0.1, None),
                             "no_such_ratio": (1, 2)})


@register("screen_stocks_bucketed", O.ratio_table_sql(
    "sparse", final="SELECT * FROM ratios WHERE pe_ratio >= 0 AND pe_ratio <= 25 AND operating_margin >= 0.1"))
def q_screen_bucketed(spark, sf_dir):
    st = _catalog_store(spark, sf_dir, "screen", "sparse")
    return FL.screen_stocks(R.ratio_table(st.scan_prices(), st.scan_fundamentals_quarterly()),
                            {"pe_ratio": (0, 25), "operating_margin": (0.1, None)})


@register("compare_tickers", O.ratio_table_sql(
    "dense", universe=_UNIVERSE_PLUS, final="SELECT ticker, pe_ratio, gross_margin FROM ratios"))
def q_compare(spark, sf_dir):
    b = _b(spark, sf_dir)
    r = R.ratio_table(b.prices(), b.fundamentals(), tickers=_companies_plus(spark, sf_dir))
    return M.compare_tickers(r, ["pe_ratio", "gross_margin", "no_such_metric"])


@register("filter_not_null", O.ratio_table_sql(
    "sparse", final="SELECT ticker, peg_ratio FROM ratios WHERE peg_ratio IS NOT NULL"))
def q_filter_not_null(spark, sf_dir):
    return FL.filter_not_null(_ratios(spark, sf_dir, "sparse"), "peg_ratio").select(
        "ticker", "peg_ratio")


_HAS_DATA = """WITH {d},
{m},
u AS (SELECT ticker FROM d_companies UNION SELECT DISTINCT ticker FROM m_prices)
SELECT u.ticker,
  u.ticker IN (SELECT ticker FROM d_prices) AS prices,
  u.ticker IN (SELECT ticker FROM m_fund_q) AS quarterly,
  u.ticker IN (SELECT ticker FROM d_fund_a) AS annual
FROM u"""


def _prefixed(density: str, prefix: str) -> str:
    """Bridge CTEs with every CTE name prefixed (two densities in one statement)."""
    import re
    text = O.bridge_ctes(density)
    names = ["base", "prices", "income_q", "balance_q", "cashflow_q", "fund_q", "income_a",
             "balance_a", "cashflow_a", "fund_a", "companies"]
    for n in names:
        text = re.sub(rf"\b{n}\b(?= AS \()", f"{prefix}{n}", text)
        text = re.sub(rf"(FROM|JOIN) {n}\b(?! AS \()", rf"\1 {prefix}{n}", text)
    return text


@register("has_data", _HAS_DATA.format(d=_prefixed("dense", "d_"), m=_prefixed("medium", "m_")))
def q_has_data(spark, sf_dir):
    d, m = _b(spark, sf_dir), _b(spark, sf_dir, "medium")
    u = d.companies().select("ticker").unionByName(m.prices().select("ticker")).distinct()
    return I.has_data(u, d.prices(), m.fundamentals(), d.fundamentals("annual"))


# =========================================================================== 2.4 joins
@register("combine_statements", W("SELECT * FROM fund_q", "medium"))
def q_combine(spark, sf_dir):
    b = _b(spark, sf_dir, "medium")
    from tickwise.operators.statements import combine_statements
    return combine_statements(b.income(), b.balance(), b.cashflow())


@register("combine_statements_shifted_dates", W(f"SELECT f.*, {_LABEL} FROM fund_q f", "medium"))
def q_combine_shifted(spark, sf_dir):
    """Balance sheets dated a day later than the income statement of the same year and label."""
    b = _b(spark, sf_dir, "medium")
    from tickwise.operators.statements import combine_statements
    label = F.concat(F.lit("Q"), F.quarter("fiscal_period").cast("string"))
    inc, bal, cf = (x.withColumn("fiscal_label", label) for x in (b.income(), b.balance(), b.cashflow()))
    return combine_statements(inc, bal.withColumn("fiscal_period", F.date_add("fiscal_period", 1)), cf)


@register("price_as_of", W(
    f"SELECT ticker, date, open, high, low, close, adjusted_close, volume, year FROM prices "
    f"WHERE date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker "
    f"ORDER BY date DESC) = 1", "sparse"))
def q_price_as_of(spark, sf_dir):
    return P.price_as_of(_b(spark, sf_dir, "sparse").prices(), AS_OF)


@register("price_x_ttm", W(
    "SELECT p.ticker, p.date, p.close, f.ttm_revenue, f.ttm_net_income, f.quarters_included "
    "FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date "
    "DESC) = 1) p LEFT JOIN feat f USING (ticker)", extra=O.feature_cte()))
def q_price_x_ttm(spark, sf_dir):
    b = _b(spark, sf_dir)
    return _price_x_ttm(b.prices(), b.fundamentals())


def _price_x_ttm(prices, quarterly):
    lp = P.latest_price(prices).select("ticker", "date", "close")
    ttm = T.ttm_fundamentals(quarterly).select(
        "ticker", F.col("revenue").alias("ttm_revenue"),
        F.col("net_income").alias("ttm_net_income"), "quarters_included")
    return lp.join(ttm, "ticker", "left")


@register("price_x_ttm_bucketed", W(
    "SELECT p.ticker, p.date, p.close, f.ttm_revenue, f.ttm_net_income, f.quarters_included "
    "FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date "
    "DESC) = 1) p LEFT JOIN feat f USING (ticker)", "sparse", extra=O.feature_cte()))
def q_price_x_ttm_bucketed(spark, sf_dir):
    st = _catalog_store(spark, sf_dir, "price_x_ttm", "sparse")
    return _price_x_ttm(st.scan_prices(), st.scan_fundamentals_quarterly())


_ALIASES = {"B5": "S1", "B10": "S999999"}


@register("resolve_universe", _HAS_DATA.split("u AS")[0].format(
    d=_prefixed("dense", "d_"), m=_prefixed("medium", "m_")) + """avail AS (
  SELECT ticker FROM d_prices WHERE ticker NOT IN (SELECT ticker FROM d_companies WHERE sector = 'SEC0')
  UNION SELECT ticker FROM m_prices),
want AS (SELECT ticker FROM d_companies),
amap AS (SELECT * FROM (VALUES ('B5', 'S1'), ('B10', 'S999999')) t(ticker, alias))
SELECT ticker FROM want WHERE ticker IN (SELECT ticker FROM avail)
UNION
SELECT a.alias FROM amap a JOIN want w USING (ticker)
WHERE a.ticker NOT IN (SELECT ticker FROM avail) AND a.alias IN (SELECT ticker FROM avail)""")
def q_resolve_universe(spark, sf_dir):
    d, m = _b(spark, sf_dir), _b(spark, sf_dir, "medium")
    sec0 = d.companies().where("sector = 'SEC0'").select("ticker")
    avail = (d.prices().select("ticker").join(sec0, "ticker", "left_anti")
             .unionByName(m.prices().select("ticker")))
    return ST.resolve_universe(d.companies(), avail, _ALIASES)


@register("coverage_check", W(f"SELECT r.ticker, r.ticker IN (SELECT ticker FROM companies) "
                              f"AS found FROM ({_REQ_SQL}) r"))
def q_coverage(spark, sf_dir):
    return Q.coverage_check(_b(spark, sf_dir).companies(), REQUIRED)


@register("completeness_by_ticker", W(f"""SELECT r.ticker,
  CAST((SELECT count(*) FROM prices p WHERE p.ticker = r.ticker) AS BIGINT) AS price_rows,
  CAST((SELECT count(*) FROM income_q i WHERE i.ticker = r.ticker) AS BIGINT) AS income_quarters,
  (SELECT count(*) FROM prices p WHERE p.ticker = r.ticker) > 0
    AND (SELECT count(*) FROM income_q i WHERE i.ticker = r.ticker) > 0 AS complete
FROM ({_REQ_SQL}) r"""))
def q_completeness(spark, sf_dir):
    b = _b(spark, sf_dir)
    return Q.completeness_by_ticker(b.prices(), b.income(), REQUIRED)


@register("valuation_summary", O.ratio_table_sql("dense", final="""SELECT r.*,
  lp.close AS current_price, strftime(lp.date, '%Y-%m-%d') AS price_date,
  f.ttm_revenue, f.ttm_net_income
FROM ratios r
LEFT JOIN (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) lp
  USING (ticker)
LEFT JOIN feat f USING (ticker)"""))
def q_valuation_summary(spark, sf_dir):
    b = _b(spark, sf_dir)
    return M.valuation_summary(b.prices(), b.fundamentals())


_GROUP_AVG = """SELECT c.sector AS "group", {aggs}, CAST(count(c.ticker) AS BIGINT) AS ticker_count
FROM companies c LEFT JOIN ratios r USING (ticker) GROUP BY c.sector"""
_GROUP_AVG_SQL = _GROUP_AVG.format(aggs=", ".join(f"{O.xround(f'avg(r.{c})', 4)} AS {c}"
                                                  for c in O.RATIO_NAMES))
_RADAR = ["operating_margin", "net_profit_margin", "gross_margin", "rd_intensity", "capex_ratio"]


def _radar_sql() -> str:
    def unpiv(src, ids, val):
        return " UNION ALL ".join(
            f"SELECT {ids}, '{m}' AS metric, {m} AS {val} FROM {src}" for m in _RADAR)
    return O.ratio_table_sql("dense", final=f"""SELECT t."group", t.ticker, t.metric,
  {_label_sql('t.metric')} AS label, t.ticker_value, coalesce(g.group_value, 0.0) AS group_value
FROM ({unpiv('(SELECT c.sector AS "group", r.* FROM companies c JOIN ratios r USING (ticker))',
             '"group", ticker', 'ticker_value')}) t
LEFT JOIN ({unpiv('(' + _GROUP_AVG_SQL + ')', '"group"', 'group_value')}) g
  ON g."group" = t."group" AND g.metric = t.metric
WHERE t.ticker_value IS NOT NULL""")


def _label_sql(c: str) -> str:
    # 'pe_ratio' -> 'Pe Ratio' (initcap of the words)
    return (f"array_to_string(list_transform(string_split({c}, '_'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def _members(spark, sf_dir) -> DataFrame:
    return _b(spark, sf_dir).companies().select(F.col("sector").alias("group"), "ticker")


@register("ticker_vs_group", _radar_sql())
def q_ticker_vs_group(spark, sf_dir):
    return M.ticker_vs_group(_ratios(spark, sf_dir, "dense"), _members(spark, sf_dir))


# =========================================================================== 2.5 aggregations
def _ttm_sql(density: str, where: str = "") -> str:
    cols = ", ".join(f"f.ttm_{c} AS {c}" for c in O.SUMMED_Q)
    return W(f"SELECT f.ticker, {cols}, f.quarters_included FROM feat f", density,
             extra=O.feature_cte(where=where))


@register("ttm_fundamentals", _ttm_sql("sparse"))
def q_ttm(spark, sf_dir):
    return T.ttm_fundamentals(_b(spark, sf_dir, "sparse").fundamentals())


@register("ttm_fundamentals_as_of", _ttm_sql("medium", "fiscal_period <= DATE '1995-06-30'"))
def q_ttm_as_of(spark, sf_dir):
    return T.ttm_fundamentals(_b(spark, sf_dir, "medium").fundamentals(), as_of="1995-06-30")


@register("date_range", W("SELECT ticker, min(date) AS min_date, max(date) AS max_date "
                          "FROM prices GROUP BY ticker", "sparse"))
def q_date_range(spark, sf_dir):
    return P.date_range(_b(spark, sf_dir, "sparse").prices())


@register("list_tickers", W("SELECT DISTINCT ticker FROM prices"))
def q_list_tickers(spark, sf_dir):
    return ST.list_tickers(_b(spark, sf_dir).prices())


@register("list_available_tickers", W("SELECT DISTINCT ticker FROM prices", "medium"))
def q_list_available(spark, sf_dir):
    return X.list_available_tickers(_b(spark, sf_dir, "medium").prices())


@register("group_averages", O.ratio_table_sql("dense", final=_GROUP_AVG_SQL))
def q_group_averages(spark, sf_dir):
    return M.group_averages(_ratios(spark, sf_dir, "dense"), _members(spark, sf_dir))


@register("data_summary", W("""SELECT ticker, strftime(min(date), '%Y-%m-%d') AS min_date,
  strftime(max(date), '%Y-%m-%d') AS max_date,
  (SELECT count(DISTINCT ticker) FROM prices) AS price_tickers,
  (SELECT count(DISTINCT ticker) FROM fund_q) AS quarterly_tickers,
  (SELECT count(DISTINCT ticker) FROM fund_a) AS annual_tickers
FROM prices WHERE ticker IN (SELECT DISTINCT ticker FROM prices ORDER BY ticker LIMIT 5)
GROUP BY ticker""", "medium"))
def q_data_summary(spark, sf_dir):
    b = _b(spark, sf_dir, "medium")
    return I.data_summary(b.prices(), b.fundamentals(), b.fundamentals("annual"))


@register("price_profile", W(f"""SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(DISTINCT ticker) AS BIGINT) AS unique_tickers, min(date) AS min_date, max(date) AS max_date,
  CAST(count(*) FILTER (WHERE ticker = '{REF_TICKER}') AS BIGINT) AS ref_rows,
  min(date) FILTER (WHERE ticker = '{REF_TICKER}') AS ref_min_date,
  max(date) FILTER (WHERE ticker = '{REF_TICKER}') AS ref_max_date,
  coalesce(min(date) <= DATE '1995-06-01', false) AS passed FROM prices"""))
def q_price_profile(spark, sf_dir):
    return Q.price_profile(_b(spark, sf_dir).prices(), REF_TICKER, "1995-06-01")


@register("fundamentals_profile", W(f"""SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(DISTINCT ticker) AS BIGINT) AS unique_tickers,
  CAST(count(*) FILTER (WHERE ticker = '{REF_TICKER}') AS BIGINT) AS ref_quarters,
  CAST(4 AS BIGINT) AS key_columns_found, true AS passed FROM income_q"""))
def q_fundamentals_profile(spark, sf_dir):
    return Q.fundamentals_profile(_b(spark, sf_dir).income(), REF_TICKER)


@register("rd_capex_availability", W("""SELECT true AS capex_available, true AS rd_available,
  (SELECT count(capex) / count(*) FROM cashflow_q) AS capex_filled_share,
  (SELECT count(rd_expense) / count(*) FROM income_q) AS rd_filled_share,
  true AS passed""", "medium"))
def q_rd_capex(spark, sf_dir):
    b = _b(spark, sf_dir, "medium")
    return Q.rd_capex_availability(b.cashflow(), b.income())


_REQ_HIT = "CASE WHEN ticker IN (SELECT ticker FROM companies) THEN 1 ELSE 0 END"
_REQ_BOTH = ("CASE WHEN ticker IN (SELECT ticker FROM prices) AND ticker IN "
             "(SELECT ticker FROM income_q) THEN 1 ELSE 0 END")
_STEPS = f"""steps AS (
SELECT 1 AS step, 'Company table' AS "check", count(*) > 0 AS passed,
  'loaded ' || count(*) || ' companies' AS message FROM companies
UNION ALL
SELECT 2, 'Coverage', sum({_REQ_HIT}) >= least(4, count(*)),
  'found ' || sum({_REQ_HIT}) || '/' || count(*) || ' required tickers' FROM ({_REQ_SQL}) r
UNION ALL
SELECT 3, 'Price data', coalesce(min(date) <= DATE '1995-06-01', false),
  count(*) || ' rows, ' || count(DISTINCT ticker) || ' tickers' FROM prices
UNION ALL
SELECT 4, 'Fundamentals data', true,
  count(*) || ' rows, ' || count(DISTINCT ticker) || ' tickers' FROM income_q
UNION ALL
SELECT 5, 'Data completeness', sum({_REQ_BOTH}) >= 3,
  sum({_REQ_BOTH}) || '/' || count(*) || ' required tickers have complete data' FROM ({_REQ_SQL}) r
UNION ALL
SELECT 6, 'R&D and CapEx data', true, 'CapEx: Available, R&D: Available')"""


@register("quality_report", W("""SELECT CAST(step AS BIGINT) AS step, "check", passed, message FROM steps
UNION ALL
SELECT 99, 'Overall', bool_and(passed), CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'FAILED' END
FROM steps""", extra=_STEPS))
def q_quality_report(spark, sf_dir):
    b = _b(spark, sf_dir)
    return Q.quality_report(b.companies(), b.prices(), b.income(), b.cashflow(), REQUIRED,
                            REF_TICKER, "1995-06-01")


# prices and statements after the sinks of _profiled_store
_PROFILED = """px2 AS (SELECT * FROM prices WHERE ticker NOT LIKE 'P%0'),
fq2 AS (SELECT * FROM fund_q WHERE ticker NOT LIKE 'P%0')"""


def _profiled_store(spark, sf_dir, name) -> ProfiledStore:
    """Tables and profiles after writes, an upsert of later days and a deletion."""
    st, b = ProfiledStore(spark, shared_dir(spark, f"profiled-{name}")), _b(spark, sf_dir, "sparse").by_ticker()
    px = b.prices()
    stored, feed = _split(px)
    st.write_prices(stored, clustered=True)
    st.write_fundamentals(b.fundamentals(), "quarterly", clustered=True)
    st.append_prices(feed, clustered=True)
    st.delete_ticker(px.select("ticker").where("ticker LIKE 'P%0'"))
    return st


@register("price_profile_maintained", W("""SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(DISTINCT ticker) AS BIGINT) AS unique_tickers, min(date) AS min_date, max(date) AS max_date,
  CAST(count(*) FILTER (WHERE ticker = 'P7') AS BIGINT) AS ref_rows,
  min(date) FILTER (WHERE ticker = 'P7') AS ref_min_date, max(date) FILTER (WHERE ticker = 'P7') AS ref_max_date,
  coalesce(min(date) <= DATE '1995-06-01', false) AS passed FROM px2""", "sparse", extra=_PROFILED))
def q_price_profile_maintained(spark, sf_dir):
    return _profiled_store(spark, sf_dir, "price").price_profile("P7", "1995-06-01")


@register("fundamentals_profile_maintained", W("""SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(DISTINCT ticker) AS BIGINT) AS unique_tickers,
  CAST(count(*) FILTER (WHERE ticker = 'P7') AS BIGINT) AS ref_quarters,
  CAST(4 AS BIGINT) AS key_columns_found, true AS passed FROM fq2""", "sparse", extra=_PROFILED))
def q_fundamentals_profile_maintained(spark, sf_dir):
    return _profiled_store(spark, sf_dir, "fundamentals").fundamentals_profile("P7")


@register("data_summary_maintained", W("""SELECT ticker, strftime(min(date), '%Y-%m-%d') AS min_date,
  strftime(max(date), '%Y-%m-%d') AS max_date,
  (SELECT count(DISTINCT ticker) FROM px2) AS price_tickers,
  (SELECT count(DISTINCT ticker) FROM fq2) AS quarterly_tickers, CAST(0 AS BIGINT) AS annual_tickers
FROM px2 WHERE ticker IN (SELECT DISTINCT ticker FROM px2 ORDER BY ticker LIMIT 5)
GROUP BY ticker""", "sparse", extra=_PROFILED))
def q_data_summary_maintained(spark, sf_dir):
    return _profiled_store(spark, sf_dir, "summary").data_summary()


# =========================================================================== 2.6 ratios
@register("ratio_table", O.ratio_table_sql("sparse"))
def q_ratio_table(spark, sf_dir):
    return _ratios(spark, sf_dir, "sparse")


@register("ratio_table_bucketed", O.ratio_table_sql("sparse"))
def q_ratio_table_bucketed(spark, sf_dir):
    """The ratio table of stored tables that are bucketed by ticker: no exchange."""
    st = _catalog_store(spark, sf_dir, "ratio_table", "sparse")
    return R.ratio_table(st.scan_prices(), st.scan_fundamentals_quarterly())


@register("ratio_table_as_of", O.ratio_table_sql("sparse", as_of="1995-12-31"))
def q_ratio_table_as_of(spark, sf_dir):
    return _ratios(spark, sf_dir, "sparse", as_of="1995-12-31")


@register("ratio_table_reported_eps", O.ratio_table_sql("dense", with_eps=True))
def q_ratio_table_eps(spark, sf_dir):
    b = _b(spark, sf_dir)
    return R.ratio_table(b.prices(), b.fundamentals(with_eps=True))


@register("all_ratios", O.ratio_table_sql("dense", as_of=AS_OF,
                                          universe=f"SELECT '{REF_TICKER}' AS ticker"))
def q_all_ratios(spark, sf_dir):
    b = _b(spark, sf_dir)
    return R.all_ratios(b.prices(), b.fundamentals(), REF_TICKER, as_of=AS_OF)


@register("ratio_panel", O.ratio_panel_sql("medium", PANEL_DATES))
def q_ratio_panel(spark, sf_dir):
    b = _b(spark, sf_dir, "medium")
    return R.ratio_panel(b.prices(), b.fundamentals(), PANEL_DATES)


@register("ratio_panel_dense", O.ratio_panel_sql("dense", DENSE_PANEL_DATES))
def q_ratio_panel_dense(spark, sf_dir):
    b = _b(spark, sf_dir)
    return R.ratio_panel(b.prices(), b.fundamentals(), DENSE_PANEL_DATES)


@register("ratio_panel_daily", O.ratio_panel_sql("dense", "dates AS (SELECT DISTINCT date AS as_of_date FROM prices)"))
def q_ratio_panel_daily(spark, sf_dir):
    """Ratios of every ticker on every trading day; the days are a DataFrame."""
    b = _b(spark, sf_dir)
    return R.ratio_panel(b.prices(), b.fundamentals(), b.prices().select("date").distinct())


# prices after the sinks of _maintained_store
_MAINTAINED = _CUTS + """,
px_kept AS (
  SELECT p.ticker, p.date, CASE WHEN p.year = 1999 OR p.date = c.cut THEN p.close + 1 ELSE p.close END AS close
  FROM prices p LEFT JOIN cuts c USING (ticker) WHERE p.ticker NOT LIKE 'P%0'),
"""
_MAINTAINED_UNIVERSE = "SELECT DISTINCT ticker FROM px_kept"


def _maintained_store(spark, sf_dir, name) -> MaintainedStore:
    """Tables and state after writes, an upsert, a replacement of one year and a deletion."""
    st, b = MaintainedStore(spark, shared_dir(spark, f"maintained-{name}")), _b(spark, sf_dir, "sparse").by_ticker()
    px = b.prices()
    stored, feed = _split(px)
    st.write_prices(stored, clustered=True)
    st.write_fundamentals(b.fundamentals(), "quarterly", clustered=True)
    st.append_prices(feed, clustered=True)
    st.write_prices(px.where(F.col("year") == 1999).withColumn("close", F.col("close") + 1), clustered=True)
    st.delete_ticker(px.select("ticker").where("ticker LIKE 'P%0'"))
    return st


@register("all_ratios_maintained", O.ratio_table_sql(
    "sparse", before=_MAINTAINED, prices="px_kept", universe="SELECT 'P77' AS ticker UNION ALL SELECT 'P20' UNION ALL SELECT 'none'",
    quarters="(SELECT * FROM fund_q WHERE ticker NOT LIKE 'P%0')"))
def q_all_ratios_maintained(spark, sf_dir):
    """One ticker, one deleted and one unknown, read off the state that the sinks keep."""
    st = _maintained_store(spark, sf_dir, "all_ratios")
    return st.all_ratios("P77").unionByName(st.all_ratios("P20")).unionByName(st.all_ratios("none"))


@register("ratio_table_maintained", O.ratio_table_sql("sparse", before=_MAINTAINED, prices="px_kept",
                                                      universe=_MAINTAINED_UNIVERSE))
def q_ratio_table_maintained(spark, sf_dir):
    return _maintained_store(spark, sf_dir, "ratio_table").ratios()


@register("valuation_summary_maintained", O.ratio_table_sql(
    "sparse", before=_MAINTAINED, prices="px_kept", universe=_MAINTAINED_UNIVERSE,
    final="SELECT r.*, px.close AS current_price, strftime(px.price_date, '%Y-%m-%d') AS price_date, feat.ttm_revenue, "
          "feat.ttm_net_income FROM ratios r LEFT JOIN px USING (ticker) LEFT JOIN feat USING (ticker)"))
def q_valuation_maintained(spark, sf_dir):
    return _maintained_store(spark, sf_dir, "valuation").valuation_summary()


for _name, _dens in [("pe_ratio", "sparse"), ("peg_ratio", "sparse"),
                     ("operating_margin", "sparse"), ("net_profit_margin", "medium"),
                     ("gross_margin", "dense"), ("rd_intensity", "sparse"),
                     ("capex_ratio", "medium"), ("revenue_growth", "sparse"),
                     ("eps_growth", "sparse")]:
    def _mk(name=_name, dens=_dens):
        def q(spark, sf_dir):
            b = _b(spark, sf_dir, dens)
            return R.single_ratio(b.prices(), b.fundamentals(), name)
        q.__name__ = f"q_{name}"
        return q
    register(_name, O.ratio_table_sql(_dens, final=f"SELECT ticker, {_name} FROM ratios"))(_mk())


@register("ttm_eps", W("SELECT ticker, CASE WHEN ttm_shares_outstanding > 0 THEN ttm_net_income / "
                       "ttm_shares_outstanding END AS ttm_eps, quarters_included FROM feat",
                       "sparse", extra=O.feature_cte()))
def q_ttm_eps(spark, sf_dir):
    return R.ttm_eps_table(_b(spark, sf_dir, "sparse").fundamentals())


@register("eps_quarterly", W("SELECT ticker, fiscal_period, net_income / NULLIF(shares_outstanding, "
                             "0) AS eps FROM fund_q", "medium"))
def q_eps_quarterly(spark, sf_dir):
    q = _b(spark, sf_dir, "medium").fundamentals()
    return q.select("ticker", "fiscal_period", T.quarterly_eps(q).alias("eps"))


def _cagr_sql(years: int) -> str:
    r = O.xround(f"pow(eps_ttm_now / eps_ttm_past, CAST(1 AS DOUBLE) / {years}) - 1.0", 4)
    return W(f"SELECT ticker, CASE WHEN n_quarters >= {4 * years} AND eps_ttm_now > 0 AND "
             f"eps_ttm_past > 0 THEN {r} END AS eps_cagr FROM feat", "sparse",
             extra=O.feature_cte(years=years))


@register("eps_cagr", _cagr_sql(5))
def q_eps_cagr(spark, sf_dir):
    return R.eps_cagr_table(_b(spark, sf_dir, "sparse").fundamentals(), 5)


@register("eps_cagr_3y", _cagr_sql(3))
def q_eps_cagr_3y(spark, sf_dir):
    return R.eps_cagr_table(_b(spark, sf_dir, "sparse").fundamentals(), 3)


_YOY = O.xround("(max(CASE WHEN rn = 1 THEN gross_profit END) - max(CASE WHEN rn = 5 THEN "
                "gross_profit END)) / NULLIF(abs(max(CASE WHEN rn = 5 THEN gross_profit END)), 0)", 4)


@register("yoy_growth", W(f"""SELECT ticker, CASE WHEN count(*) >= 5 THEN
  {_YOY} END AS gross_profit_growth
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_period DESC) AS rn FROM fund_q)
GROUP BY ticker""", "medium"))
def q_yoy_growth(spark, sf_dir):
    return R.yoy_growth(_b(spark, sf_dir, "medium").fundamentals(), "gross_profit")


# =========================================================================== 2.7 windows
@register("rank_by_metric", O.ratio_table_sql("sparse", final=(
    "SELECT row_number() OVER (ORDER BY pe_ratio DESC, ticker) AS rank, ticker, pe_ratio "
    "FROM ratios WHERE pe_ratio IS NOT NULL")))
def q_rank(spark, sf_dir):
    return M.rank_by_metric(_ratios(spark, sf_dir, "sparse"), "pe_ratio", ascending=False)


@register("newest_n_quarters", W(
    "SELECT ticker, fiscal_period, revenue, row_number() OVER (PARTITION BY ticker ORDER BY "
    "fiscal_period DESC) AS rn FROM fund_q QUALIFY rn <= 4", "sparse"))
def q_newest_n(spark, sf_dir):
    return T.newest_n_quarters(_b(spark, sf_dir, "sparse").fundamentals(), 4).select(
        "ticker", "fiscal_period", "revenue", "rn")


@register("nth_row_offset", W(
    "SELECT ticker, fiscal_period, revenue, lag(revenue, 4) OVER (PARTITION BY ticker ORDER BY "
    "fiscal_period) AS revenue_back_4 FROM fund_q", "medium"))
def q_nth_row(spark, sf_dir):
    return T.nth_row_offset(_b(spark, sf_dir, "medium").fundamentals(), "revenue", 4)


_W = "OVER (PARTITION BY ticker ORDER BY fiscal_period)"


@register("row_slice_sum", W(
    "SELECT ticker, fiscal_period, " + " + ".join(
        f"coalesce(lag(revenue, {k}) {_W}, 0)" for k in range(16, 20))
    + " AS revenue_rows_17_20 FROM fund_q", "medium"))
def q_row_slice(spark, sf_dir):
    return T.row_slice_sum(_b(spark, sf_dir, "medium").fundamentals(), "revenue", 17, 4)


@register("normalize_price", W(
    "SELECT p.ticker, p.date, p.close / NULLIF(b.base, 0) * 100 AS close FROM prices p "
    "JOIN (SELECT ticker, arg_min(close, date) AS base FROM prices GROUP BY ticker) b "
    "USING (ticker)"))
def q_normalize(spark, sf_dir):
    return P.normalize_price(_b(spark, sf_dir).prices().select("ticker", "date", "close"))


# =========================================================================== 2.8 sorts / top-k
@register("latest_price", W("SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ticker "
                            "ORDER BY date DESC) = 1", "sparse"))
def q_latest_price(spark, sf_dir):
    return P.latest_price(_b(spark, sf_dir, "sparse").prices())


@register("top_n", O.ratio_table_sql("sparse", final=(
    "SELECT ticker, operating_margin FROM ratios ORDER BY operating_margin DESC NULLS LAST, "
    "ticker LIMIT 10")))
def q_top_n(spark, sf_dir):
    r = _ratios(spark, sf_dir, "sparse")
    return (r.orderBy(F.col("operating_margin").desc_nulls_last(), "ticker").limit(10)
            .select("ticker", "operating_margin"))


@register("sort_series", W("SELECT ticker, date, close FROM prices ORDER BY ticker, date",
                           "medium"))
def q_sort_series(spark, sf_dir):
    return _b(spark, sf_dir, "medium").prices().select("ticker", "date", "close").orderBy(
        "ticker", "date")


@register("recent_statements", W(
    "SELECT ticker, fiscal_period, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_period "
    "DESC) AS rn, revenue, net_income FROM fund_q QUALIFY rn <= 8"))
def q_recent(spark, sf_dir):
    return D.recent_statements(_b(spark, sf_dir).fundamentals(), ["revenue", "net_income"], 8)


# =========================================================================== 2.9 set operations
@register("union_all", "WITH " + _prefixed("dense", "d_") + ",\n" + _prefixed("medium", "m_")
          + "\nSELECT * FROM d_income_q UNION ALL SELECT * FROM m_income_q")
def q_union_all(spark, sf_dir):
    return ST.union_all(_b(spark, sf_dir).income(), _b(spark, sf_dir, "medium").income())


@register("dedupe_keep_last", W(
    "SELECT ticker, date, open, high, low, CASE WHEN year = 2000 THEN close + 1 ELSE close END "
    "AS close, adjusted_close, volume, year FROM prices"))
def q_dedupe(spark, sf_dir):
    px = _b(spark, sf_dir).prices()
    newer = px.where(F.col("year") == 2000).withColumn("close", F.col("close") + 1)
    u = px.withColumn("_seq", F.lit(0)).unionByName(newer.withColumn("_seq", F.lit(1)))
    return ST.dedupe_keep_last(u, ["ticker", "date"], "_seq").drop("_seq")


@register("distinct_values", W("SELECT DISTINCT fiscal_year FROM fund_q", "sparse"))
def q_distinct(spark, sf_dir):
    return ST.distinct_values(_b(spark, sf_dir, "sparse").fundamentals(), "fiscal_year")


# =========================================================================== 2.10 scalars
@register("add_ticker_column", W(f"SELECT '{REF_TICKER}' AS ticker, {_PCOLS.partition(', ')[2]} FROM prices",
                                 "sparse"))
def q_add_ticker(spark, sf_dir):
    return S.add_ticker_column(_b(spark, sf_dir, "sparse").prices().drop("ticker"), REF_TICKER)


@register("year_of_date", W("SELECT ticker, date, CAST(year(date) AS BIGINT) AS year FROM prices",
                            "sparse"))
def q_year_of_date(spark, sf_dir):
    return _b(spark, sf_dir, "sparse").prices().select("ticker", "date",
                                                       S.year_of_date("date").alias("year"))


@register("free_cash_flow", W("SELECT *, operating_cash_flow - abs(capex) AS free_cash_flow "
                              "FROM cashflow_q", "medium"))
def q_fcf(spark, sf_dir):
    return _b(spark, sf_dir, "medium").cashflow().withColumn("free_cash_flow", S.free_cash_flow())


_QM = ("SELECT ticker, fiscal_period, gross_profit / NULLIF(revenue, 0) AS gross_margin, "
       "operating_income / NULLIF(revenue, 0) AS operating_margin, "
       "net_income / NULLIF(revenue, 0) AS net_margin FROM fund_q")


@register("quarter_margins", W(_QM, "sparse"))
def q_quarter_margins(spark, sf_dir):
    return D.quarter_margins(_b(spark, sf_dir, "sparse").fundamentals())


@register("round_2", W(f"SELECT ticker, date, {O.xround('close', 2)} AS close FROM prices",
                       "sparse"))
def q_round_2(spark, sf_dir):
    return _b(spark, sf_dir, "sparse").prices().select("ticker", "date",
                                                       S.round_2("close").alias("close"))


@register("round_4", W(f"SELECT ticker, date, {O.xround('adjusted_close', 4)} AS adjusted_close "
                       "FROM prices", "sparse"))
def q_round_4(spark, sf_dir):
    return _b(spark, sf_dir, "sparse").prices().select(
        "ticker", "date", S.round_4("adjusted_close").alias("adjusted_close"))


@register("metric_label", O.ratio_table_sql("dense", final=(
    "SELECT DISTINCT metric, " + _label_sql("metric") + " AS label FROM (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric FROM ratios" for m in O.RATIO_NAMES) + ")")))
def q_metric_label(spark, sf_dir):
    r = _ratios(spark, sf_dir, "dense")
    long = M.unpivot_metrics(r, list(R.RATIO_COLUMNS), ["ticker"])
    return long.select("metric", S.metric_label(F.col("metric")).alias("label")).distinct()


@register("parse_iso_date", W("SELECT ticker, strftime(date, '%Y-%m-%d') AS date_text, date "
                              "FROM prices", "medium"))
def q_parse_iso(spark, sf_dir):
    px = _b(spark, sf_dir, "medium").prices().select(
        "ticker", F.date_format("date", "yyyy-MM-dd").alias("date_text"))
    return px.withColumn("date", S.parse_iso_date("date_text"))


@register("candle_colour", W("SELECT ticker, date, CASE WHEN close < open THEN 'red' ELSE 'green' "
                             "END AS colour FROM prices"))
def q_candle(spark, sf_dir):
    return _b(spark, sf_dir).prices().select("ticker", "date", S.candle_colour().alias("colour"))


# =========================================================================== 2.11 chart datasets
@register("candlestick_data", W(
    "SELECT ticker, date, open, high, low, close, volume, CASE WHEN close < open THEN 'red' "
    "ELSE 'green' END AS colour FROM prices WHERE date BETWEEN DATE '1999-01-01' AND "
    "DATE '1999-12-31'"))
def q_candlestick(spark, sf_dir):
    return D.candlestick_data(_b(spark, sf_dir).prices(), "1999-01-01", "1999-12-31")


@register("price_comparison_data", W(
    "SELECT p.ticker, p.date, p.close / NULLIF(b.base, 0) * 100 AS close FROM prices p "
    "JOIN (SELECT ticker, arg_min(close, date) AS base FROM prices WHERE date BETWEEN "
    "DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY ticker) b USING (ticker) "
    "WHERE p.date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'", "medium"))
def q_price_comparison(spark, sf_dir):
    return D.price_comparison_data(_b(spark, sf_dir, "medium").prices(), "2000-01-01",
                                   "2000-12-31", normalize=True)


_CMP = ["pe_ratio", "operating_margin", "net_profit_margin", "gross_margin"]


@register("ratio_comparison_data", O.ratio_table_sql("dense", final=" UNION ALL ".join(
    f"SELECT ticker, '{m}' AS metric, {_label_sql(repr(m))} AS label, {m} AS value FROM ratios"
    for m in _CMP)))
def q_ratio_comparison(spark, sf_dir):
    return D.ratio_comparison_data(_ratios(spark, sf_dir, "dense"))


@register("margin_trend_data", W(_QM))
def q_margin_trend(spark, sf_dir):
    return D.margin_trend_data(_b(spark, sf_dir).fundamentals())


@register("revenue_earnings_data", W("SELECT ticker, fiscal_period, revenue, net_income FROM fund_q",
                                     "medium"))
def q_revenue_earnings(spark, sf_dir):
    return D.revenue_earnings_data(_b(spark, sf_dir, "medium").fundamentals())


@register("ranking_data", O.ratio_table_sql("sparse", final=(
    "SELECT row_number() OVER (ORDER BY pe_ratio, ticker) AS rank, ticker, pe_ratio, "
    "CASE WHEN pe_ratio <> 0 THEN printf('%.2f', pe_ratio) ELSE '' END AS label "
    "FROM ratios WHERE pe_ratio IS NOT NULL "
    "ORDER BY pe_ratio, ticker LIMIT 10")))
def q_ranking_data(spark, sf_dir):
    return D.ranking_data(_ratios(spark, sf_dir, "sparse"), "pe_ratio", 10, ascending=True)


@register("group_radar_data", _radar_sql())
def q_group_radar(spark, sf_dir):
    return D.group_radar_data(_ratios(spark, sf_dir, "dense"), _members(spark, sf_dir))
