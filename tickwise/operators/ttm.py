"""Trailing-twelve-month sums and the positional quarter features behind the ratios.

The reference sorts one ticker's quarters newest first and reads rows by
position (rows 1-4 summed, row 1 vs row 5, rows 17-20). Two forms here:

* ``latest_features``: ``row_number() <= K`` over the newest-first order
  (a partial WindowGroupLimit runs before the shuffle), then the positions
  are conditional aggregates ``max(CASE WHEN rn = k ...)``.
* ``quarter_features`` (as-of panels): positions are window offsets over
  (ticker ORDER BY fiscal_period) -- as of a quarter, "row k of the
  newest-first list" is ``lag(c, k-1)`` -- so one window pass yields the
  inputs of every ratio *as of every quarter*, and each as-of date picks the
  quarter in force.

A ticker's window partition holds at most one row per fiscal period (keys
are unique after ingest), so its size is bounded by the calendar, not by
data volume; no hot-key salting is needed here.

Sums of a few quarters are written as explicit additions in newest-first
order with nulls as 0, which is how a sequential sum over the sorted list
behaves, and keeps the floating-point result independent of task layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.schemas import NON_SUMMED, SUMMABLE_TYPES

FEATURE_PREFIX = "ttm_"


def summable_columns(df: DataFrame) -> list[str]:
    """Numeric item columns TTM sums (not keys, identifiers or years)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, SUMMABLE_TYPES) and f.name not in NON_SUMMED]


def quarterly_eps(df: DataFrame) -> Column | None:
    """Per-quarter EPS: the eps column if the table has one, else NI / shares (D4)."""
    if "eps" in df.columns:
        return F.col("eps")
    if "net_income" in df.columns and "shares_outstanding" in df.columns:
        return F.try_divide(F.col("net_income"), F.col("shares_outstanding"))
    return None


def _window() -> Window:
    return Window.partitionBy("ticker").orderBy("fiscal_period")


def _at(c: str, k: int) -> Column:
    """Value of row k+1 of the newest-first list (k quarters back)."""
    return F.col(c) if k == 0 else F.lag(c, k).over(_window())


def _ordered_sum(c: str, offsets) -> Column:
    terms = [F.coalesce(_at(c, k), F.lit(0)) for k in offsets]
    return reduce(lambda a, b: a + b, terms)


def _q(c: str) -> str:
    return f"`{c}`"


def _eps_sql(df: DataFrame) -> str | None:
    if "eps" in df.columns:
        return "eps"
    if "net_income" in df.columns and "shares_outstanding" in df.columns:
        return "try_divide(net_income, shares_outstanding)"
    return None


_W = "OVER (PARTITION BY ticker ORDER BY fiscal_period)"


def quarter_features(q: DataFrame, years: int = 5) -> DataFrame:
    """One row per (ticker, fiscal_period) with every ratio input as of that quarter.

    Columns: ticker, fiscal_period, n_quarters (quarters up to and including
    this one), quarters_included (min(n, 4)), ttm_<c> for each summable
    column, revenue_q1 / revenue_q5, eps_q1 / eps_q5, eps_ttm_now,
    eps_ttm_past (rows 4*years-3 .. 4*years), is_latest.

    Expressions are handed to Spark as SQL text (one call each); the plan is
    the same as with Column objects, without hundreds of driver round trips.
    """
    cols = summable_columns(q)
    eps = _eps_sql(q)
    base = q.selectExpr("ticker", "fiscal_period", *[_q(c) for c in cols],
                        *([f"{eps} AS _q_eps"] if eps else []))

    def at(c: str, k: int) -> str:
        return _q(c) if k == 0 else f"lag({_q(c)}, {k}) {_W}"

    def osum(c: str, ks) -> str:
        return " + ".join(f"coalesce({at(c, k)}, 0)" for k in ks)

    n = f"CAST(row_number() {_W} AS BIGINT)"
    out = ["ticker", "fiscal_period", f"{n} AS n_quarters",
           f"least({n}, CAST(4 AS BIGINT)) AS quarters_included"]
    out += [f"{osum(c, range(4))} AS {FEATURE_PREFIX}{c}" for c in cols]
    if "revenue" in cols:
        out += ["revenue AS revenue_q1", f"{at('revenue', 4)} AS revenue_q5"]
    if eps:
        out += ["_q_eps AS eps_q1", f"{at('_q_eps', 4)} AS eps_q5",
                f"{osum('_q_eps', range(4))} AS eps_ttm_now",
                f"{osum('_q_eps', range(4 * years - 4, 4 * years))} AS eps_ttm_past"]
    out.append(f"row_number() {_W} = count(1) OVER (PARTITION BY ticker) AS is_latest")
    return base.selectExpr(*out)


def latest_features(q: DataFrame, years: int = 5, least: int = 5) -> DataFrame:
    """The features of each ticker's newest quarter, skew-safe.

    Only the newest ``K = max(least, 4*years)`` quarters can matter, so the rows
    are cut with ``row_number() <= K`` first: Spark plans a partial
    WindowGroupLimit *before* the shuffle, so every map task forwards at most
    K rows per ticker however many rows one ticker has. The positions are
    then read with conditional aggregates in the same ticker partitioning (no
    second exchange). ``n_quarters`` counts the quarters of that cut, K at most:
    it is there for the >= 5 and >= 4*years gates, which it keeps exact.
    """
    k_max = max(least, 4 * years)
    cols = summable_columns(q)
    eps = _eps_sql(q)

    def at(c: str, k: int) -> str:
        return f"max(CASE WHEN rn = {k} THEN {_q(c)} END)"

    def osum(c: str, ks) -> str:
        return " + ".join(f"coalesce({at(c, k)}, 0)" for k in ks)

    aggs = [f"{at('fiscal_period', 1)} AS fiscal_period",
            "CAST(count(1) AS BIGINT) AS n_quarters",
            "least(CAST(count(1) AS BIGINT), CAST(4 AS BIGINT)) AS quarters_included"]
    aggs += [f"{osum(c, range(1, 5))} AS {FEATURE_PREFIX}{c}" for c in cols]
    if "revenue" in cols:
        aggs += [f"{at('revenue', 1)} AS revenue_q1", f"{at('revenue', 5)} AS revenue_q5"]
    if eps:
        aggs += [f"{at('_q_eps', 1)} AS eps_q1", f"{at('_q_eps', 5)} AS eps_q5",
                 f"{osum('_q_eps', range(1, 5))} AS eps_ttm_now",
                 f"{osum('_q_eps', range(4 * years - 3, 4 * years + 1))} AS eps_ttm_past"]
    base = ", ".join(["ticker", "fiscal_period", *[_q(c) for c in cols],
                      *([f"{eps} AS _q_eps"] if eps else [])])
    # one statement: the plan is the same as chained DataFrame calls, built in one round trip
    sql = f"""SELECT ticker, {", ".join(aggs)}
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_period DESC) AS rn
      FROM (SELECT {base} FROM {{q}}))
WHERE rn <= {k_max}
GROUP BY ticker"""
    return q.sparkSession.sql(sql, q=q)


def latest_features_by_parts(q: DataFrame, years: int = 5) -> DataFrame:
    """``latest_features`` of rows that all have a ticker: only the newest five quarters of a ticker are moved whole.

    The quarters before them count, and those a few years back add to ``eps_ttm_past``, so they are moved with their EPS
    alone. Both parts lie by ticker, so their join moves nothing.
    """
    if 4 * years <= 5:
        return latest_features(q, years)
    eps = _eps_sql(q)
    near = latest_features(q, years=1)
    counted = ["n_quarters", "quarters_included", *(["eps_ttm_past"] if eps else [])]
    far = latest_features(q.selectExpr("ticker", "fiscal_period", *([f"{eps} AS eps"] if eps else [])), years)
    return near.drop(*counted).join(far.select("ticker", *counted), "ticker").select(*near.columns)


def newest_n_quarters(q: DataFrame, n: int = 4) -> DataFrame:
    """The newest n quarters per ticker, with their newest-first position ``rn``.

    ``row_number <= n`` lets Spark insert a partial WindowGroupLimit, so each
    map task forwards at most n rows per ticker to the shuffle.
    """
    w = Window.partitionBy("ticker").orderBy(F.col("fiscal_period").desc())
    return q.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= n)


def ttm_fundamentals(q: DataFrame, as_of=None) -> DataFrame:
    """TTM sums of every numeric item over each ticker's newest 4 quarters.

    1-3 quarters still sum (``quarters_included`` < 4, D1); an all-null item
    sums to 0 (D2); a ticker with no quarters (as of the date) has no row.
    """
    if as_of is not None:
        q = q.where(F.col("fiscal_period") <= F.lit(as_of).cast("date"))
    cols = summable_columns(q)
    f = latest_features(q, years=1, least=4)
    return f.select("ticker", *[F.col(FEATURE_PREFIX + c).alias(c) for c in cols],
                    F.col("quarters_included").cast("bigint"))


def nth_row_offset(q: DataFrame, column: str, k: int = 4) -> DataFrame:
    """Per quarter: the value k rows further back in the newest-first list."""
    return q.select("ticker", "fiscal_period", column,
                    _at(column, k).alias(f"{column}_back_{k}"))


def row_slice_sum(q: DataFrame, column: str, start: int, length: int = 4) -> DataFrame:
    """Per quarter: sum of newest-first rows start..start+length-1 (1-based)."""
    return q.select("ticker", "fiscal_period",
                    _ordered_sum(column, range(start - 1, start - 1 + length))
                    .alias(f"{column}_rows_{start}_{start + length - 1}"))
