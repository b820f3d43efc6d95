"""Ratio goldens (hand-computed from the formulas) and the semantics D-list."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import PRICE_SCHEMA, d
from tickwise.operators import metrics as M
from tickwise.operators import ratios as R
from tickwise.operators.ttm import ttm_fundamentals
from tickwise.schemas import RATIO_COLUMNS


def _prices(spark, ticker, rows):
    return spark.createDataFrame(rows, PRICE_SCHEMA).withColumn("ticker", F.lit(ticker))


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


@pytest.fixture
def aapl(spark, sample_prices_df, sample_fundamentals_df):
    return (sample_prices_df.withColumn("ticker", F.lit("AAPL")),
            sample_fundamentals_df.withColumn("ticker", F.lit("AAPL")))


def test_single_ticker_goldens(aapl):
    px, fq = aapl
    r = _one(R.ratio_table(px, fq))
    assert r["as_of_date"] == "latest"                     # D24
    assert r["pe_ratio"] == 17.61                          # 155 / 8.8
    assert r["gross_margin"] == 0.4
    assert r["operating_margin"] == 0.2483
    assert r["net_profit_margin"] == 0.2023
    assert r["rd_intensity"] == 0.0499
    assert r["revenue_growth"] is None and r["eps_growth"] is None   # 4 rows, need 5
    assert r["peg_ratio"] is None                                    # 4 rows, need 20
    assert r["capex_ratio"] is None                                  # column absent


def test_capex_all_null_column_is_zero(aapl):
    px, fq = aapl
    r = _one(R.ratio_table(px, fq.withColumn("capex", F.lit(None).cast("double"))))
    assert r["capex_ratio"] == 0.0                                   # D2


def _quarters(spark, n, eps_fn, ticker="X", start_year=2000):
    rows = []
    for i in range(n):
        y, q = start_year + i // 4, i % 4 + 1
        end = (dt.date(y, q * 3 + 1, 1) - dt.timedelta(days=1)) if q < 4 else dt.date(y, 12, 31)
        rows.append((ticker, end, y, 100.0, eps_fn(n - i)))      # n - i = newest-first row
    return spark.createDataFrame(rows, "ticker string, fiscal_period date, fiscal_year bigint, "
                                       "revenue double, eps double")


def test_peg_golden(spark):
    px = _prices(spark, "X", [(d("2005-01-03"), 100.0, 100.0, 100.0, 100.0, 100.0, 1)])
    q = _quarters(spark, 20, lambda k: 2.0 if k <= 4 else 1.0)
    r = _one(R.ratio_table(px, q))
    assert r["pe_ratio"] == 12.5
    assert _one(R.eps_cagr_table(q))["eps_cagr"] == 0.1487
    assert r["peg_ratio"] == 0.84
    q19 = _quarters(spark, 19, lambda k: 2.0 if k <= 4 else 1.0)
    assert _one(R.ratio_table(px, q19))["peg_ratio"] is None


def test_fewer_than_four_quarters_still_sum(spark, aapl):
    _, fq = aapl
    t = _one(ttm_fundamentals(fq, as_of="2023-06-30"))               # D1
    assert t["quarters_included"] == 2 and t["revenue"] == 210000.0


def test_eps_present_but_null_gives_null_pe(spark, aapl):
    px, fq = aapl
    r = _one(R.ratio_table(px, fq.withColumn("eps", F.lit(None).cast("double"))))
    assert r["pe_ratio"] is None                                     # D4: TTM eps 0


def test_derived_eps_uses_summed_shares(spark, aapl):
    px, fq = aapl
    q = fq.drop("eps").withColumn("shares_outstanding", F.lit(10000).cast("bigint"))
    # TTM eps = 88000 / 40000 = 2.2 (shares summed, D3) -> pe = 155 / 2.2
    assert _one(R.ratio_table(px, q))["pe_ratio"] == round(155 / 2.2, 2)


def test_growth_is_positional_and_uses_abs(spark):
    rows = [("X", d("2020-03-31"), 2020, -50.0), ("X", d("2020-06-30"), 2020, 1.0),
            ("X", d("2020-09-30"), 2020, 1.0), ("X", d("2021-03-31"), 2021, 1.0),  # gap: no Q4
            ("X", d("2021-06-30"), 2021, 25.0)]
    q = spark.createDataFrame(rows, "ticker string, fiscal_period date, fiscal_year bigint, "
                                    "revenue double")
    g = _one(R.yoy_growth(q, "revenue"))["revenue_growth"]
    assert g == round((25.0 - -50.0) / 50.0, 4)                      # D7 row 1 vs row 5, D8 abs


def test_zero_revenue_gives_null_margin(spark, aapl):
    px, fq = aapl
    r = _one(R.ratio_table(px, fq.withColumn("revenue", F.lit(0.0))))
    assert r["gross_margin"] is None and r["pe_ratio"] == 17.61     # D16


def test_missing_ticker_gets_null_row(spark, aapl):
    px, fq = aapl
    rows = {r.ticker: r for r in R.ratio_table(px, fq, tickers=["AAPL", "NOPE"]).collect()}
    assert set(rows) == {"AAPL", "NOPE"}
    assert all(rows["NOPE"][c] is None for c in RATIO_COLUMNS)     # D11


def test_as_of_matches_panel(spark, aapl):
    px, fq = aapl
    one = _one(R.ratio_table(px, fq, as_of="2024-01-04"))
    panel = {r.as_of_date: r.asDict() for r in
             R.ratio_panel(px, fq, ["2023-12-31", "2024-01-04"]).collect()}
    assert panel["2024-01-04"] == one
    assert panel["2023-12-31"]["pe_ratio"] is None                  # no price yet


def test_panel_of_many_dates_matches_single_as_of_tables(spark, aapl):
    px, fq = aapl
    dates = [dt.date(2023, 6, 1) + dt.timedelta(days=3 * i) for i in range(80)]
    panel = {r.as_of_date: r.asDict() for r in R.ratio_panel(px, fq, dates).collect()}
    assert len(panel) == 80
    for day in (dates[0], dates[40], dates[79]):
        assert panel[day.isoformat()] == R.ratio_table(px, fq, as_of=day.isoformat()).first().asDict()


@pytest.mark.parametrize("tickers", ["AAPL", ["AAPL"], ("AAPL", "AAPL")])
def test_ticker_arguments(spark, aapl, tickers):
    px, fq = aapl
    assert [r.ticker for r in R.ratio_table(px, fq, tickers).collect()] == ["AAPL"]
    assert {r.ticker for r in R.ratio_panel(px, fq, ["2024-01-04"], tickers).collect()} == {"AAPL"}
    frame = spark.createDataFrame([("AAPL",)], "ticker string")
    assert [r.ticker for r in R.ratio_table(px, fq, frame).collect()] == ["AAPL"]


def test_ranking_of_an_unknown_metric_is_empty(spark):
    from tickwise.plans.datasets import ranking_data
    r = spark.createDataFrame([("A", 1.0)], "ticker string, pe_ratio double")
    assert ranking_data(r, "no_such_metric").collect() == []


def test_screen_bounds():
    from tickwise.operators.filters import screen_bounds
    assert screen_bounds(pe_max=20, peg_min=None, gross_margin_min=0.1, gross_margin_max=0.9) == {
        "pe_ratio": (None, 20), "gross_margin": (0.1, 0.9)}
    with pytest.raises(TypeError):
        screen_bounds(colour_min=1)


def test_rank_ties_broken_by_ticker(spark):
    r = spark.createDataFrame([("B", 1.0), ("A", 1.0), ("C", None), ("D", 0.5)],
                              "ticker string, pe_ratio double")
    full = [tuple(x) for x in M.rank_by_metric(r, "pe_ratio").collect()]
    assert sorted(full) == [(1, "D", 0.5), (2, "A", 1.0), (3, "B", 1.0)]   # D12, nulls dropped
    top = [tuple(x) for x in M.rank_by_metric(r, "pe_ratio", ascending=False, top_n=2).collect()]
    assert sorted(top) == [(1, "A", 1.0), (2, "B", 1.0)]
    assert M.rank_by_metric(r, "nope").count() == 0


def test_global_row_number_matches_single_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 1000).alias("v"),
                                     F.col("id").cast("string").alias("ticker"))
    a = M.global_row_number(df.repartition(7), [F.col("v"), F.col("ticker")])
    b = df.withColumn("rank", F.row_number().over(Window.orderBy("v", "ticker")))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_group_average_counts_requested(spark, aapl):
    px, fq = aapl
    r = R.ratio_table(px, fq)
    members = spark.createDataFrame([("tech", "AAPL"), ("tech", "NOPE")], "group string, ticker string")
    g = _one(M.group_averages(r, members))
    assert g["ticker_count"] == 2 and g["gross_margin"] == 0.4      # D18, nulls ignored


def test_results_invariant_to_partitioning(spark, aapl):
    px, fq = aapl
    a = sorted(map(tuple, R.ratio_table(px, fq).collect()))
    b = sorted(map(tuple, R.ratio_table(px.repartition(5), fq.repartition(3)).collect()))
    assert a == b


def test_screen_skips_unknown_and_fails_nulls(spark, aapl):
    from tickwise.operators.filters import screen_stocks
    px, fq = aapl
    r = R.ratio_table(px, fq, tickers=["AAPL", "NOPE"])
    out = screen_stocks(r, {"pe_ratio": (None, 20), "bogus": (0, 1)})
    assert [x.ticker for x in out.collect()] == ["AAPL"]


def test_resolve_universe_aliases(spark):
    from tickwise.operators.sets import resolve_universe, ticker_frame
    want = ticker_frame(spark, ["AAPL", "GOOGL", "BRK.B", "MSFT", "ZZZ"])
    avail = ticker_frame(spark, ["AAPL", "GOOG", "BRK-B", "BRK.B", "MSFT"])
    got = [r.ticker for r in resolve_universe(want, avail).collect()]
    # GOOGL absent -> GOOG added; BRK.B present -> its alias is not added
    assert got == ["AAPL", "BRK.B", "GOOG", "MSFT"]
