"""The nine valuation, margin and growth ratios for all tickers in one plan.

Physical shape of ``ratio_table`` (latest): one scan of each table; the
fundamentals go through one exchange on ticker for the quarter window and
the newest quarter is read off the same window (no second exchange); prices
are reduced by a partial ``max_by`` aggregate, so at most one row per ticker
per task crosses the network; the two one-row-per-ticker sides are joined
on ticker and the ratios are a pure projection.

Null rules (match the reference):
  pe_ratio          round(close / ttm_eps, 2); null without price, TTM, or eps 0/null
  peg_ratio         round(pe / (cagr * 100), 2) from the rounded pe and cagr; null unless both > 0
  eps cagr          needs 4*years quarters; (sum rows 1-4 / sum rows 4y-3..4y)^(1/years) - 1,
                    both sums > 0, rounded to 4
  *_margin          round(ttm item / ttm revenue, 4); null if revenue 0
  rd_intensity      round(|ttm rd_expense| / ttm revenue, 4)
  capex_ratio       round(|ttm capex| / ttm revenue, 4)
  revenue_growth    needs 5 quarters; round((q1 - q5) / |q5|, 4); null if q5 null/0 or q1 null
  eps_growth        same on the per-quarter EPS
A ratio whose input column is absent from the table is null; an input column
that is present but all null sums to 0 (so e.g. rd_intensity is 0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.operators.asof import as_of_join, as_of_slices, normalize_dates
from tickwise.operators.filters import filter_date_range
from tickwise.operators.ttm import FEATURE_PREFIX, latest_features, newest_n_quarters, quarter_features
from tickwise.schemas import RATIO_COLUMNS

def _ttm(fcols, c) -> str | None:
    return FEATURE_PREFIX + c if FEATURE_PREFIX + c in fcols else None


def ttm_eps_sql(fcols) -> str:
    """TTM EPS: summed eps if the table has the column, else TTM NI / TTM shares.

    ``fcols`` are feature column names, so presence is decided at plan time.
    """
    if FEATURE_PREFIX + "eps" in fcols:
        return FEATURE_PREFIX + "eps"
    if {FEATURE_PREFIX + "net_income", FEATURE_PREFIX + "shares_outstanding"} <= set(fcols):
        return (f"CASE WHEN {FEATURE_PREFIX}shares_outstanding > 0 THEN try_divide("
                f"{FEATURE_PREFIX}net_income, {FEATURE_PREFIX}shares_outstanding) END")
    return "CAST(NULL AS DOUBLE)"


def ttm_eps(fcols) -> Column:
    return F.expr(ttm_eps_sql(fcols))


_NULL = "CAST(NULL AS DOUBLE)"


def _margin(fcols, num: str, absolute: bool = False) -> str:
    n, r = _ttm(fcols, num), _ttm(fcols, "revenue")
    if n is None or r is None:
        return _NULL
    if absolute:
        n = f"abs({n})"
    return f"round(try_divide({n}, {r}), 4)"


def _growth(cur: str, back: str) -> str:
    return f"CASE WHEN n_quarters >= 5 THEN round(try_divide({cur} - {back}, abs({back})), 4) END"


def eps_cagr_sql(fcols, years: int = 5) -> str:
    if "eps_ttm_now" not in fcols:
        return _NULL
    return (f"CASE WHEN n_quarters >= {4 * years} AND eps_ttm_now > 0 AND eps_ttm_past > 0 "
            f"THEN round(pow(try_divide(eps_ttm_now, eps_ttm_past), 1.0D / {years}) - 1.0D, 4) END")


def eps_cagr(fcols, years: int = 5) -> Column:
    return F.expr(eps_cagr_sql(fcols, years))


def ratio_sql(fcols, years: int = 5) -> dict[str, str]:
    """Ratio expressions (SQL text) over a frame holding ``close`` plus quarter features."""
    pe = f"round(try_divide(close, {ttm_eps_sql(fcols)}), 2)"
    cagr = eps_cagr_sql(fcols, years)
    return {
        "pe_ratio": pe,
        "peg_ratio": f"CASE WHEN ({pe}) > 0 AND ({cagr}) > 0 THEN "
                     f"round(({pe}) / (({cagr}) * 100.0D), 2) END",
        "operating_margin": _margin(fcols, "operating_income"),
        "net_profit_margin": _margin(fcols, "net_income"),
        "gross_margin": _margin(fcols, "gross_profit"),
        "revenue_growth": _growth("revenue_q1", "revenue_q5") if "revenue_q1" in fcols else _NULL,
        "eps_growth": _growth("eps_q1", "eps_q5") if "eps_q1" in fcols else _NULL,
        "rd_intensity": _margin(fcols, "rd_expense", absolute=True),
        "capex_ratio": _margin(fcols, "capex", absolute=True),
    }


def ratio_projection(fcols, years: int, label_sql: str) -> list[str]:
    """Select list of the ratio table over a frame with ``ticker``, ``close`` and quarter features."""
    r = ratio_sql(fcols, years)
    return ["ticker", f"{label_sql} AS as_of_date"] + [f"{r[c]} AS {c}" for c in RATIO_COLUMNS]


def ticker_names(tickers):
    """A ticker argument in one form: None, a frame with ``ticker``, or a list (a string is one ticker)."""
    if tickers is None or isinstance(tickers, DataFrame):
        return tickers
    return [tickers] if isinstance(tickers, str) else list(dict.fromkeys(tickers))


def ticker_frame_of(spark, tickers) -> DataFrame:
    tickers = ticker_names(tickers)
    if isinstance(tickers, DataFrame):
        return tickers.select("ticker").distinct()
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")


def restrict(df: DataFrame, tickers) -> DataFrame:
    """Rows of the wanted tickers: a predicate for one, a semi join for more."""
    tickers = ticker_names(tickers)
    if tickers is None:
        return df
    if isinstance(tickers, list) and len(tickers) == 1:
        return df.where(F.col("ticker") == F.lit(tickers[0]))
    return df.join(ticker_frame_of(df.sparkSession, tickers), "ticker", "left_semi")


def ratio_inputs(prices: DataFrame, fundamentals: DataFrame, tickers=None,
                 as_of=None, years: int = 5) -> DataFrame:
    """One row per ticker: close (as of) joined with the newest quarter's features."""
    p = restrict(prices.select("ticker", "date", "close"), tickers)
    q = restrict(fundamentals, tickers)
    if as_of is not None:
        d = F.lit(as_of).cast("date")
        q = q.where(F.col("fiscal_period") <= d)
        # the close comes from dates <= as_of only (year partitions after it are
        # skipped); every stored ticker stays in the universe via a ticker-only scan
        upto = restrict(filter_date_range(prices, None, as_of).select("ticker", "date", "close"),
                         tickers)
        px = (upto.groupBy("ticker")
              .agg(F.max_by("close", "date").alias("close"), F.max("date").alias("price_date")))
        if tickers is None:
            px = p.select("ticker").distinct().join(px, "ticker", "left")
    else:
        px = p.groupBy("ticker").agg(F.max_by("close", "date").alias("close"),
                                     F.max("date").alias("price_date"))
    feats = latest_features(q, years).drop("fiscal_period")
    if tickers is not None:
        px = ticker_frame_of(prices.sparkSession, tickers).join(px, "ticker", "left")
    return px.join(feats, "ticker", "left")


def ratio_table(prices: DataFrame, fundamentals: DataFrame, tickers=None, as_of=None,
                years: int = 5) -> DataFrame:
    """All nine ratios for every ticker (of ``tickers`` or of the price table).

    A requested ticker without data gets a row of null ratios.
    """
    base = ratio_inputs(prices, fundamentals, tickers, as_of, years)
    label = "latest" if as_of is None else str(as_of)
    return base.selectExpr(*ratio_projection(set(base.columns), years, f"'{label}'"))


def valuation_columns(fcols) -> list[str]:
    """What the valuation summary shows beside the ratios."""
    return (["close AS current_price", "date_format(price_date, 'yyyy-MM-dd') AS price_date"]
            + [f"{FEATURE_PREFIX}{c} AS ttm_{c}" for c in ("revenue", "net_income") if FEATURE_PREFIX + c in fcols])


def valuation_table(prices: DataFrame, fundamentals: DataFrame, tickers=None,
                    years: int = 5) -> DataFrame:
    """Ratios plus latest close / date and TTM revenue / net income, in one plan
    (the ratio inputs already carry them)."""
    base = ratio_inputs(prices, fundamentals, tickers, None, years)
    fcols = set(base.columns)
    return base.selectExpr(*ratio_projection(fcols, years, "'latest'"), *valuation_columns(fcols))


def all_ratios(prices: DataFrame, fundamentals: DataFrame, ticker: str, as_of=None,
               years: int = 5) -> DataFrame:
    """Single-ticker form (same columns and values as ``ratio_table`` for it).

    The ticker predicate reaches both scans. The price is a global ``max_by``
    (reduced inside every scan task, so even a huge history is split across
    tasks); the cut to the newest quarters leaves a few rows per scan task to
    exchange.
    """
    spark = prices.sparkSession
    p = prices.where(F.col("ticker") == F.lit(ticker)).select("date", "close")
    q = fundamentals.where(F.col("ticker") == F.lit(ticker))
    if as_of is not None:
        d = F.lit(as_of).cast("date")
        p = p.where(F.col("date") <= d)
        q = q.where(F.col("fiscal_period") <= d)
    feats = latest_features(q, years).drop("fiscal_period")
    fcols = set(feats.columns) | {"close"}
    label = "latest" if as_of is None else str(as_of)
    proj = ratio_projection(fcols, years, f"'{label}'")
    proj[0] = "p.ticker AS ticker"
    return spark.sql(
        f"""SELECT {", ".join(proj)}
FROM (SELECT :t AS ticker, max_by(close, date) AS close FROM {{p}}) p
LEFT JOIN {{f}} f ON f.ticker = p.ticker""", args={"t": ticker}, p=p, f=feats)


def ratio_panel(prices: DataFrame, fundamentals: DataFrame, dates, tickers=None,
                years: int = 5) -> DataFrame:
    """One row per (ticker, as_of_date) for many as-of dates in one job.

    Quarter features are computed once for every quarter; each as-of date
    then takes the quarter (and price) in force on that date. ``dates`` may be a list, or
    a DataFrame whose first column holds the dates (``as_of_slices``: any number of them).
    """
    p = restrict(prices.select("ticker", "date", "close"), tickers)
    q = restrict(fundamentals, tickers)
    feats = quarter_features(q, years)
    fcols = [c for c in feats.columns if c not in ("ticker", "fiscal_period", "is_latest")]
    universe = (ticker_frame_of(prices.sparkSession, tickers) if tickers is not None
                else p.select("ticker").distinct())
    sources = [(feats, "fiscal_period", fcols, ""), (p, "date", ["close"], "")]
    grid = (as_of_slices(universe, dates, sources) if isinstance(dates, DataFrame)
            else as_of_join(universe, normalize_dates(dates), sources))
    return grid.selectExpr(*ratio_projection(set(fcols), years,
                                              "date_format(as_of_date, 'yyyy-MM-dd')"))


def single_ratio(prices: DataFrame, fundamentals: DataFrame, name: str, tickers=None,
                 as_of=None, years: int = 5) -> DataFrame:
    """(ticker, <ratio>) for one of the nine ratios."""
    return ratio_table(prices, fundamentals, tickers, as_of, years).select("ticker", name)


def ttm_eps_table(fundamentals: DataFrame, as_of=None) -> DataFrame:
    """(ticker, ttm_eps, quarters_included) from the newest four quarters."""
    q = fundamentals
    if as_of is not None:
        q = q.where(F.col("fiscal_period") <= F.lit(as_of).cast("date"))
    f = latest_features(q)
    return f.select("ticker", ttm_eps(set(f.columns)).alias("ttm_eps"), "quarters_included")


def eps_cagr_table(fundamentals: DataFrame, years: int = 5, as_of=None) -> DataFrame:
    q = fundamentals
    if as_of is not None:
        q = q.where(F.col("fiscal_period") <= F.lit(as_of).cast("date"))
    f = latest_features(q, years)
    return f.select("ticker", eps_cagr(set(f.columns), years).alias("eps_cagr"))



def yoy_growth(fundamentals: DataFrame, column: str, as_of=None) -> DataFrame:
    """(ticker, <column>_growth): newest quarter vs the fifth-newest, positional (D7).

    Needs 5 quarters; null when the older value is null or 0 or the newer is null.
    """
    q = fundamentals
    if as_of is not None:
        q = q.where(F.col("fiscal_period") <= F.lit(as_of).cast("date"))
    if column not in q.columns:
        return q.select("ticker").distinct().withColumn(f"{column}_growth", F.expr(_NULL))
    # the cut to five rows happens before the shuffle; positions are read by conditional aggregates
    newest = newest_n_quarters(q.select("ticker", "fiscal_period", F.col(column).alias("_v")), 5)
    at = {k: F.max(F.when(F.col("rn") == k, F.col("_v"))).alias(f"_q{k}") for k in (1, 5)}
    return (newest.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_quarters"), *at.values())
            .select("ticker", F.expr(_growth("_q1", "_q5")).alias(f"{column}_growth")))
