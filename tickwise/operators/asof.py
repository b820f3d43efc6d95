"""As-of lookups: for each (ticker, as-of date), the newest row dated on or before it.

Rows are first tagged with the as-of date whose interval (previous date,
this date] contains them, then reduced with ``max_by`` per (ticker, as-of
date). ``max_by`` is a partial aggregate, so a ticker holding a large share
of the rows is reduced inside every map task before the shuffle. Intervals
with no row inherit the previous interval's value through a window over the
(ticker x dates) grid, whose partitions hold one row per requested date.

``as_of_slices`` is for many dates, given as a DataFrame (daily dates over decades): see there.

The tag is an equi join on month bins against a broadcast interval table whose
size is known on the driver (dates plus months spanned), for any number of dates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def normalize_dates(dates) -> list[dt.date]:
    out = set()
    for d in dates:
        out.add(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)))
    return sorted(out)


def _month_starts(lo: dt.date, hi: dt.date):
    y, m = lo.year, lo.month
    while (y, m) <= (hi.year, hi.month):
        yield dt.date(y, m, 1)
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)


def tag_as_of(df: DataFrame, date_col: str, dates) -> DataFrame:
    """Add ``as_of_date`` = the smallest requested date >= date_col; drop later rows."""
    dates = normalize_dates(dates)
    d = F.col(date_col)
    df = df.where(d <= F.lit(dates[-1]))
    spark = df.sparkSession
    # intervals (lo, hi] with one row per calendar month they cover; the first is open below
    rows, prev = [], None
    for hi in dates:
        first_month = (prev + dt.timedelta(days=1)) if prev else hi.replace(day=1)
        for b in _month_starts(first_month, hi):
            rows.append((b, prev, hi))
        prev = hi
    schema = T.StructType([T.StructField("_ibin", T.DateType()),
                           T.StructField("_ilo", T.DateType()),
                           T.StructField("as_of_date", T.DateType())])
    intervals = spark.createDataFrame(rows, schema)
    # rows before the first date's month all belong to the first interval
    tagged = df.withColumn("_bin", F.greatest(F.trunc(d, "month"), F.lit(dates[0].replace(day=1))))
    cond = ((F.col("_bin") == F.col("_ibin"))
            & (F.col("_ilo").isNull() | (F.col(date_col) > F.col("_ilo")))
            & (F.col(date_col) <= F.col("as_of_date")))
    # broadcast size is len(rows), known here on the driver
    out = tagged.join(F.broadcast(intervals), cond, "inner")
    return out.drop("_bin", "_ibin", "_ilo")


def as_of_join(universe: DataFrame, dates, sources: list[tuple]) -> DataFrame:
    """Grid of (ticker, as_of_date) with the as-of values of each source.

    ``sources``: list of (df, date_col, value_cols, prefix). Output columns:
    ticker, as_of_date, then ``prefix + c`` for each value column (null when
    the source has no row on or before the date).
    """
    dates = normalize_dates(dates)
    grid = universe.select("ticker").distinct().select(
        "ticker", F.explode(F.array(*[F.lit(d) for d in dates])).alias("as_of_date"))
    w = (Window.partitionBy("ticker").orderBy("as_of_date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names, out_cols = [], []
    for i, (df, date_col, value_cols, prefix) in enumerate(sources):
        name = f"_s{i}"
        tagged = tag_as_of(df.select("ticker", date_col, *value_cols), date_col, dates)
        fields = ", ".join(f"`{c}`" for c in value_cols)
        red = (tagged.groupBy("ticker", "as_of_date")
               .agg(F.expr(f"max_by(struct({fields}), `{date_col}`)").alias(name)))
        # all joins on (ticker, as_of_date) share one hash partitioning
        grid = grid.join(red, ["ticker", "as_of_date"], "left")
        names.append(name)
        out_cols += [f"{name}.`{c}` AS `{prefix}{c}`" for c in value_cols]
    # one window (one exchange on ticker) carries every source forward
    grid = grid.select("ticker", "as_of_date",
                       *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])
    return grid.selectExpr("ticker", "as_of_date", *out_cols)


def as_of_slices(universe: DataFrame, dates: DataFrame, sources: list[tuple]) -> DataFrame:
    """``as_of_join`` for a DataFrame of dates (its first column): a sort-merge over time slices.

    History is cut into calendar years. Rows and dates of one (ticker, year) meet in one sort: a date takes the last row before
    it. What was in force when a year began is carried into it: the last row of each (ticker, year), a partial aggregate,
    and a window over a ticker's years. So a ticker's history is spread over as many tasks as it has years, and what is shuffled are the
    source rows and one row per ticker and year; the dates are attached to the latter after the shuffle, never
    as a grid of tickers and dates. The year's days, at most 366, come from a broadcast table of calendar years.
    """
    spark = universe.sparkSession
    days = dates.select(F.col(dates.columns[0]).cast("date").alias("day")).where("day is not null").distinct()
    first, last = days.agg(F.min("day"), F.max("day")).first()
    names = [f"_v{i}" for i in range(len(sources))]
    out = [f"{n}.`{c}` AS `{prefix}{c}`" for n, (_, _, cols, prefix) in zip(names, sources, strict=True) for c in cols]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    year = F.when(F.year("day") < (first.year if first else 0), (first.year if first else 0) - 1).otherwise(F.year("day"))
    events = None
    for i, (df, date_col, cols, _) in enumerate(sources):
        values = F.struct(*cols)
        one = (df.where(F.col(date_col) <= F.lit(last))  # a constant: reaches the scan
               .select("ticker", F.col(date_col).alias("day"),
                       *[(values if j == i else F.lit(None)).alias(n) for j, n in enumerate(names)]))
        events = one if events is None else _union_typed(events, one, names)
    events = events.withColumn("slice", year)
    lasts = events.groupBy("ticker", "slice").agg(*[
        F.max_by(n, F.when(F.col(n).isNotNull(), F.col("day"))).alias(n) for n in names])
    opened = universe.select("ticker").distinct().select(
        "ticker", F.explode(F.sequence(F.lit(first.year if first else 0), F.lit(last.year if last else 0))).alias("slice"))
    before = Window.partitionBy("ticker").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = (_union_typed(lasts.withColumn("opens", F.lit(False)),
                            opened.select("*", *[F.lit(None).alias(n) for n in names], F.lit(True).alias("opens")), names)
               .select("ticker", "slice", "opens", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in names])
               .where("opens").drop("opens").repartition(parts, "ticker", "slice"))
    calendar = days.groupBy(F.year("day").alias("slice")).agg(F.collect_list("day").alias("days"))  # days of a year
    asked = carried.join(F.broadcast(calendar), "slice").select(
        "ticker", "slice", *names,
        F.explode(F.expr("""concat(array(named_struct('day', make_date(slice, 1, 1), 'kind', 0)),
                                   transform(days, d -> named_struct('day', d, 'kind', 2)))""")).alias("at"))
    asked = asked.select("ticker", "slice", "at.day", "at.kind", *[F.when(F.col("at.kind") == 0, F.col(n)).alias(n) for n in names])
    rows = events.where(F.col("slice") >= (first.year if first else 0)).repartition(parts, "ticker", "slice").select(
        "ticker", "slice", "day", F.lit(1).alias("kind"), *names)
    upto = (Window.partitionBy("ticker", "slice").orderBy("day", "kind")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # both sides lie by (ticker, slice): the window sorts them where they are
    return (rows.unionByName(asked)
            .select("ticker", F.col("day").alias("as_of_date"), "kind",
                    *[F.last(n, ignorenulls=True).over(upto).alias(n) for n in names])
            .where("kind = 2").selectExpr("ticker", "as_of_date", *out))


def _union_typed(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Union by name where a value column may be an untyped null on one side."""
    types = {f.name: f.dataType for df in (a, b) for f in df.schema.fields if f.dataType != T.NullType()}
    cast = [[F.col(c).cast(types[c]).alias(c) if c in names and c in types else F.col(c) for c in a.columns] for _ in (0, 1)]
    return a.select(*cast[0]).unionByName(b.select(*cast[1]))
