"""DuckDB SQL text for the bridge tables and the ratio inputs (the oracle side).

Written independently of the Spark code: the ratio inputs here use the
newest-first ``row_number`` pivot, while the Spark plan uses lag windows.
"""

from __future__ import annotations

_TICKER = {
    "dense": "replace(p_brand, 'Brand#', 'B')",
    "medium": "'S' || CAST(l_suppkey AS VARCHAR)",
    "sparse": "'P' || CAST(l_partkey AS VARCHAR)",
}

_KEYS_Q = ("CAST(year(d) AS BIGINT) AS fiscal_year, "
           "last_day(make_date(year(d), quarter(d) * 3, 1)) AS fiscal_period")
_KEYS_A = "CAST(year(d) AS BIGINT) AS fiscal_year, make_date(year(d), 12, 31) AS fiscal_period"

_REV = "sum(ep * (1 - disc))"
_COGS = "sum(qty * rp)"
_RET = "sum(CASE WHEN rf = 'R' THEN ep ELSE 0 END)"
_TAX = "sum(ep * tax)"


def _income(keys: str, with_eps: bool) -> str:
    ni = f"CAST({_REV} - {_COGS} - 0.5 * {_RET} - {_TAX} AS DOUBLE)"
    eps = (f", {ni} / NULLIF(CAST(sum(p_size) AS BIGINT) + 1000, 0) AS eps" if with_eps else "")
    return f"""SELECT ticker, {keys},
    CAST({_REV} AS DOUBLE) AS revenue,
    CAST({_REV} - {_COGS} AS DOUBLE) AS gross_profit,
    CAST({_REV} - {_COGS} - {_RET} AS DOUBLE) AS operating_income,
    {ni} AS net_income,
    CAST(sum(CASE WHEN rf = 'A' THEN -ep * disc END) AS DOUBLE) AS rd_expense{eps}
  FROM base GROUP BY ALL"""


def _balance(keys: str) -> str:
    return (f"SELECT ticker, {keys}, CAST(sum(p_size) AS BIGINT) + 1000 AS shares_outstanding "
            f"FROM base GROUP BY ALL")


def _cashflow(keys: str) -> str:
    return (f"SELECT ticker, {keys}, CAST({_REV} - {_TAX} AS DOUBLE) AS operating_cash_flow, "
            f"CAST(-{_TAX} AS DOUBLE) AS capex FROM base WHERE ls = 'F' GROUP BY ALL")


def _combined(sfx: str) -> str:
    return f"""SELECT i.*, b.shares_outstanding, c.operating_cash_flow, c.capex,
    c.operating_cash_flow - abs(c.capex) AS free_cash_flow
  FROM income_{sfx} i
  LEFT JOIN balance_{sfx} b USING (ticker, fiscal_year, fiscal_period)
  LEFT JOIN cashflow_{sfx} c USING (ticker, fiscal_year, fiscal_period)"""


def bridge_ctes(density: str = "dense", with_eps: bool = False) -> str:
    t = _TICKER[density]
    return f"""base AS (
  SELECT {t} AS ticker, CAST(l_shipdate AS DATE) AS d,
    l_extendedprice / NULLIF(l_quantity, 0) AS px,
    CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS ep,
    CAST(p_retailprice AS DECIMAL(18,2)) AS rp, CAST(l_discount AS DECIMAL(4,2)) AS disc,
    CAST(l_tax AS DECIMAL(4,2)) AS tax, l_discount, p_size,
    l_returnflag AS rf, l_linestatus AS ls, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey),
prices AS (
  SELECT ticker, d AS date,
    first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
    max(px) AS high, min(px) AS low,
    last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
    last(px * (1 - l_discount) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)
      AS adjusted_close,
    CAST(sum(qty) AS BIGINT) AS volume, CAST(year(d) AS BIGINT) AS year
  FROM base GROUP BY ticker, d),
income_q AS ({_income(_KEYS_Q, with_eps)}),
balance_q AS ({_balance(_KEYS_Q)}),
cashflow_q AS ({_cashflow(_KEYS_Q)}),
fund_q AS ({_combined('q')}),
income_a AS ({_income(_KEYS_A, with_eps)}),
balance_a AS ({_balance(_KEYS_A)}),
cashflow_a AS ({_cashflow(_KEYS_A)}),
fund_a AS ({_combined('a')}),
companies AS (
  SELECT DISTINCT replace(p_brand, 'Brand#', 'B') AS ticker, p_brand AS company_name,
    'SEC' || CAST(CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 5 AS VARCHAR) AS sector
  FROM part)"""


def with_bridge(body: str, density: str = "dense", with_eps: bool = False,
                extra: str = "") -> str:
    ctes = bridge_ctes(density, with_eps)
    if extra:
        ctes += ",\n" + extra
    return f"WITH {ctes}\n{body}"


def xround(expr: str, n: int) -> str:
    """Spark's ``round`` on a DOUBLE: HALF_UP applied to the shortest decimal
    string of the value (so 2.675 -> 2.68, 1.005 -> 1.01), never -0.0."""
    return (f"(CAST(round(TRY_CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), "
            f"{n}) AS DOUBLE) + 0.0)")


def osum(col: str, ranks, rn: str = "rn") -> str:
    """Fixed-order sum of the values at newest-first positions ``ranks`` (nulls as 0)."""
    return " + ".join(f"coalesce(max(CASE WHEN {rn} = {k} THEN {col} END), 0)" for k in ranks)


def oat(col: str, k: int, rn: str = "rn") -> str:
    return f"max(CASE WHEN {rn} = {k} THEN {col} END)"


SUMMED_Q = ["revenue", "gross_profit", "operating_income", "net_income", "rd_expense",
            "shares_outstanding", "operating_cash_flow", "capex", "free_cash_flow"]


def feature_cte(src: str = "fund_q", name: str = "feat", years: int = 5, part: str = "ticker",
                where: str = "", eps_col: str | None = None, summed=None) -> str:
    """Per ``part`` group: newest-first pivot of the quarter rows (the ratio inputs)."""
    summed = summed or SUMMED_Q
    eps = eps_col or "net_income / NULLIF(shares_outstanding, 0)"
    w = f"WHERE {where}" if where else ""
    cols = ",\n    ".join(f"{osum(c, range(1, 5))} AS ttm_{c}" for c in summed)
    past = range(4 * years - 3, 4 * years + 1)
    return f"""{name}_r AS (
  SELECT *, {eps} AS q_eps,
    row_number() OVER (PARTITION BY {part} ORDER BY fiscal_period DESC) AS rn,
    count(*) OVER (PARTITION BY {part}) AS nq
  FROM {src} {w}),
{name} AS (
  SELECT {part}, CAST(max(nq) AS BIGINT) AS n_quarters, CAST(least(max(nq), 4) AS BIGINT) AS quarters_included,
    {cols},
    {oat('revenue', 1)} AS revenue_q1, {oat('revenue', 5)} AS revenue_q5,
    {oat('q_eps', 1)} AS eps_q1, {oat('q_eps', 5)} AS eps_q5,
    {osum('q_eps', range(1, 5))} AS eps_ttm_now,
    {osum('q_eps', past)} AS eps_ttm_past
  FROM {name}_r GROUP BY {part})"""


def ratio_select(f: str = "f", close: str = "close", years: int = 5,
                 ttm_eps: str | None = None) -> str:
    """The nine ratio expressions over a feature row ``f`` and a close column."""
    eps = ttm_eps or (f"CASE WHEN {f}.ttm_shares_outstanding > 0 THEN "
                      f"{f}.ttm_net_income / {f}.ttm_shares_outstanding END")
    pe = xround(f"{close} / NULLIF({eps}, 0)", 2)
    cagr = (f"CASE WHEN {f}.n_quarters >= {4 * years} AND {f}.eps_ttm_now > 0 AND "
            f"{f}.eps_ttm_past > 0 THEN " + xround(
                f"pow({f}.eps_ttm_now / {f}.eps_ttm_past, CAST(1 AS DOUBLE) / {years}) - 1.0", 4)
            + " END")

    def m(num, absolute=False):
        n = f"abs({f}.ttm_{num})" if absolute else f"{f}.ttm_{num}"
        return xround(f"{n} / NULLIF({f}.ttm_revenue, 0)", 4)

    def g(a, b):
        return (f"CASE WHEN {f}.n_quarters >= 5 THEN "
                + xround(f"({f}.{a} - {f}.{b}) / NULLIF(abs({f}.{b}), 0)", 4) + " END")

    return f"""{pe} AS pe_ratio,
    CASE WHEN {pe} > 0 AND ({cagr}) > 0 THEN {xround(f"{pe} / (({cagr}) * 100.0)", 2)} END AS peg_ratio,
    {m('operating_income')} AS operating_margin,
    {m('net_income')} AS net_profit_margin,
    {m('gross_profit')} AS gross_margin,
    {g('revenue_q1', 'revenue_q5')} AS revenue_growth,
    {g('eps_q1', 'eps_q5')} AS eps_growth,
    {m('rd_expense', True)} AS rd_intensity,
    {m('capex', True)} AS capex_ratio"""


RATIO_NAMES = ["pe_ratio", "peg_ratio", "operating_margin", "net_profit_margin", "gross_margin",
               "revenue_growth", "eps_growth", "rd_intensity", "capex_ratio"]


def ratio_table_sql(density: str = "sparse", as_of: str | None = None, years: int = 5,
                    universe: str = "SELECT DISTINCT ticker FROM prices",
                    final: str = "SELECT * FROM ratios", with_eps: bool = False, prices: str = "prices",
                    quarters: str = "fund_q", before: str = "") -> str:
    """Latest (or as-of) ratio table for every ticker of ``universe``; ``before`` may define other inputs."""
    where = f"fiscal_period <= DATE '{as_of}'" if as_of else ""
    pcond = f"WHERE date <= DATE '{as_of}'" if as_of else ""
    label = f"'{as_of}'" if as_of else "'latest'"
    eps_col = "eps" if with_eps else None
    summed = SUMMED_Q + (["eps"] if with_eps else [])
    ttm_eps = "f.ttm_eps" if with_eps else None
    extra = before + feature_cte(src=quarters, years=years, where=where, eps_col=eps_col, summed=summed) + f""",
universe AS ({universe}),
px AS (SELECT ticker, arg_max(close, date) AS close, max(date) AS price_date FROM {prices} {pcond} GROUP BY ticker),
ratios AS (
  SELECT u.ticker, {label} AS as_of_date, {ratio_select('f', 'px.close', years, ttm_eps)}
  FROM universe u LEFT JOIN px USING (ticker) LEFT JOIN feat f ON f.ticker = u.ticker)"""
    return with_bridge(final, density, with_eps=with_eps, extra=extra)


def dates_cte(dates) -> str:
    vals = ", ".join(f"(DATE '{d}')" for d in dates)
    return f"dates AS (SELECT * FROM (VALUES {vals}) t(as_of_date))"


def ratio_panel_sql(density: str, dates, years: int = 5) -> str:
    """Brute force: every quarter / price row joined to every as-of date on or after it.

    ``dates`` is a list, or the text of a ``dates(as_of_date)`` CTE."""
    extra = (dates if isinstance(dates, str) else dates_cte(dates)) + """,
fq AS (SELECT f.*, dt.as_of_date FROM fund_q f JOIN dates dt ON f.fiscal_period <= dt.as_of_date),
""" + feature_cte(src="fq", part="ticker, as_of_date", years=years) + f""",
universe AS (SELECT DISTINCT ticker FROM prices),
px AS (SELECT p.ticker, dt.as_of_date, arg_max(p.close, p.date) AS close
       FROM prices p JOIN dates dt ON p.date <= dt.as_of_date GROUP BY ALL),
ratios AS (
  SELECT u.ticker, strftime(dt.as_of_date, '%Y-%m-%d') AS as_of_date,
    {ratio_select('f', 'px.close', years)}
  FROM universe u CROSS JOIN dates dt
  LEFT JOIN px ON px.ticker = u.ticker AND px.as_of_date = dt.as_of_date
  LEFT JOIN feat f ON f.ticker = u.ticker AND f.as_of_date = dt.as_of_date)"""
    return with_bridge("SELECT * FROM ratios", density, extra=extra)
