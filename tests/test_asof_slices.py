"""As-of lookups over time slices: equal to the interval path, and to a plain loop; a hot ticker is spread."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_plans import _plan, no_broadcast  # noqa: F401
from tickwise.operators.asof import as_of_join, as_of_slices


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _history(spark, seed, n):
    rng = random.Random(seed)
    day = lambda: dt.date(rng.randint(2001, 2009), rng.randint(1, 12), rng.randint(1, 28))
    rows = {(f"T{rng.randint(0, 5)}", day()): (rng.choice([None, float(i)]), i) for i in range(n)}
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], "ticker string, d date, v double, w int"), rows


def test_slices_equal_intervals_and_a_plain_loop(spark):
    a, plain = _history(spark, 1, 300)
    b, _ = _history(spark, 2, 15)
    universe = spark.createDataFrame([(f"T{i}",) for i in range(8)], "ticker string")
    rng = random.Random(3)
    for lo, hi, n in ((2000, 2010, 400), (2003, 2003, 9), (2005, 2012, 40), (1990, 1991, 5)):
        days = sorted({dt.date(rng.randint(lo, hi), rng.randint(1, 12), rng.randint(1, 28)) for _ in range(n)})
        dates = spark.createDataFrame([(x,) for x in [*days, days[0], None]], "on date")
        sources = [(a, "d", ["v", "w"], "a_"), (b, "d", ["w"], "b_")]
        got = as_of_slices(universe, dates, sources)
        assert _rows(got) == _rows(as_of_join(universe, days, sources))
        for r in got.limit(50).collect():
            known = [k for k in plain if k[0] == r.ticker and k[1] <= r.as_of_date]
            assert (r.a_v, r.a_w) == (plain[max(known)] if known else (None, None))
    empty = spark.createDataFrame([], "on date")
    assert as_of_slices(universe, empty, sources).count() == 0
    assert as_of_slices(universe.limit(0), dates, sources).count() == 0
    assert as_of_slices(universe, dates, [(a.limit(0), "d", ["v"], "")]).where("v is not null").count() == 0


def test_a_hot_ticker_is_spread_and_no_grid_is_shuffled(spark, no_broadcast):  # noqa: F811
    px = spark.range(0, 20_000, 1, 4).select(
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 40).cast("string"))).alias("ticker"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("d"), F.col("id").cast("double").alias("close"))
    dates = px.select("d").distinct()
    got = as_of_slices(px.select("ticker"), dates, [(px, "d", ["close"], "")])
    plan = _plan(got)
    # shuffled: rows by (ticker, slice), one row per ticker and year; the window over rows and dates adds none
    top = plan[:plan.index("Union")]
    assert "Exchange" not in top and "Window" in top
    assert "Generate explode(concat(" in plan
    n = got.count()
    assert n == 21 * dates.count()
    spread = (got.where("ticker = 'HOT'").groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(spread) >= 8 and max(r["count"] for r in spread) < 0.4 * dates.count()
