"""Ratio table vs a plain-Python transcription of the formulas on a randomized fixture.

The fixture has many tickers with 0-26 quarters, gaps, nulls, zero and
negative values, so every gate and null rule is exercised in one Spark job.
"""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

from tickwise.operators import ratios as R


def sround(x, n):
    """Spark's round on a double: HALF_UP on the shortest decimal string."""
    if x is None:
        return None
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP))


def div(a, b):
    if a is None or b is None or b == 0:
        return None
    return a / b


def nsum(vals):
    s = 0.0
    for v in vals:
        if v is not None:
            s += v
    return s


def brute(prices, quarters, years=5):
    out = {}
    tickers = sorted({p[0] for p in prices})
    for t in tickers:
        close = max((p for p in prices if p[0] == t), key=lambda p: p[1])[2]
        q = sorted((r for r in quarters if r[0] == t), key=lambda r: r[1], reverse=True)
        r = dict.fromkeys(["pe_ratio", "peg_ratio", "operating_margin", "net_profit_margin",
                           "gross_margin", "revenue_growth", "eps_growth", "rd_intensity",
                           "capex_ratio"])
        if q:
            top = q[:4]
            # row: ticker, period end, year, revenue, gross, operating, net, rd, shares
            rev, gp, oi, ni, rd = (nsum(x[i] for x in top) for i in (3, 4, 5, 6, 7))
            sh = int(sum(x[8] for x in top if x[8] is not None))
            eps = ni / sh if sh > 0 else None
            r["pe_ratio"] = sround(div(close, eps), 2)
            r["gross_margin"] = sround(div(gp, rev), 4)
            r["operating_margin"] = sround(div(oi, rev), 4)
            r["net_profit_margin"] = sround(div(ni, rev), 4)
            r["rd_intensity"] = sround(div(abs(rd), rev), 4)
            ceps = [div(x[6], x[8]) for x in q]
            if len(q) >= 5:
                r["revenue_growth"] = sround(div(None if q[0][3] is None or q[4][3] is None
                                                 else q[0][3] - q[4][3],
                                                 None if q[4][3] is None else abs(q[4][3])), 4)
                r["eps_growth"] = sround(div(None if ceps[0] is None or ceps[4] is None
                                             else ceps[0] - ceps[4],
                                             None if ceps[4] is None else abs(ceps[4])), 4)
            cagr = None
            if len(q) >= 4 * years:
                now, past = nsum(ceps[:4]), nsum(ceps[4 * years - 4:4 * years])
                if now > 0 and past > 0:
                    cagr = sround((now / past) ** (1 / years) - 1, 4)
            pe = r["pe_ratio"]
            if pe is not None and pe > 0 and cagr is not None and cagr > 0:
                r["peg_ratio"] = sround(pe / (cagr * 100), 2)
        out[t] = r
    return out


def test_ratio_table_matches_bruteforce(spark):
    rnd = random.Random(7)

    def val(lo, hi, p_null=0.08, p_zero=0.04):
        u = rnd.random()
        if u < p_null:
            return None
        if u < p_null + p_zero:
            return 0.0
        return round(rnd.uniform(lo, hi), 2)

    prices, quarters = [], []
    for i in range(400):
        t = f"T{i}"
        for k in range(rnd.randint(1, 4)):
            prices.append((t, dt.date(2010, 1, 1) + dt.timedelta(days=rnd.randint(0, 3000)),
                           round(rnd.uniform(-5, 300), 2)))
        n = rnd.choice([0, 1, 3, 4, 5, 8, 19, 20, 21, 26])
        ends = sorted(rnd.sample(range(40), n))          # quarter indexes, with gaps
        for e in ends:
            y, qq = 2000 + e // 4, e % 4 + 1
            end = (dt.date(y, qq * 3 + 1, 1) - dt.timedelta(days=1)) if qq < 4 else dt.date(y, 12, 31)
            sh = None if rnd.random() < 0.05 else rnd.choice([0, 100, 1000, 5000])
            quarters.append((t, end, y, val(-100, 1000), val(-100, 500), val(-300, 300),
                             val(-300, 300), val(-50, 0), sh))
    p = spark.createDataFrame(prices, "ticker string, date date, close double")
    q = spark.createDataFrame(quarters, "ticker string, fiscal_period date, fiscal_year bigint, "
                                        "revenue double, gross_profit double, "
                                        "operating_income double, net_income double, "
                                        "rd_expense double, shares_outstanding bigint")
    got = {r.ticker: r.asDict() for r in R.ratio_table(p, q).collect()}
    want = brute(prices, quarters)
    assert set(got) == set(want)
    bad = [(t, c, got[t][c], want[t][c]) for t in want for c in want[t]
           if got[t][c] != want[t][c]]
    assert bad == []
