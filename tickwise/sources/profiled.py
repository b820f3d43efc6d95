"""Profiles that add up: counts per partition folder and ticker, kept by the sinks.

``ProfiledStore`` is a ``Store`` with a small table beside each of its tables: for every (partition folder, ticker) the
number of rows, the first and last day, and for statements how many values each item has. A sink recomputes the folders
of its change set, and only those are read; a report adds the numbers up. Rows, spans and filled shares add over folders;
tickers are counted once because a ticker lives in one bucket, whatever its years.

A profile is partitioned like its table, so folders are replaced as a whole and a repeated update gives the same numbers. A
sink that dies before its profile is done leaves a mark, and the next reader profiles that table anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.operators.quality import KEY_INCOME_COLUMNS
from tickwise.operators.ratios import ticker_frame_of
from tickwise.operators.ttm import summable_columns
from tickwise.sources.store import TABLES, Store


class ProfiledStore(Store):
    """Tables with additive profiles; may be combined with ``MaintainedStore`` by inheritance."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        if self.layout != "bucketed":
            raise ValueError("profiles need the bucketed layout")
        self._profiles: dict[str, DataFrame] = {}

    def profile_path(self, table: str) -> str:
        return f"{self.root}/_profile/{TABLES[table]}"

    def _behind(self, table: str) -> str:
        return f"{self.root}/_profile/_behind_{table}"

    def refresh(self) -> None:
        super().refresh()
        self._profiles.clear()

    # ------------------------------------------------------------------ upkeep
    def _counted(self, rows: DataFrame, table: str) -> DataFrame:
        """Rows of some folders as one row per folder and ticker; a partial aggregate."""
        day = "date" if table == "prices" else "fiscal_period"
        if "ticker_bucket" not in rows.columns:  # a table that does not exist yet
            rows = rows.withColumn("ticker_bucket", self.bucket_of("ticker", self.buckets(table), table))
        items = [] if table == "prices" else [F.count(f"`{c}`").alias(f"n_{c}") for c in summable_columns(rows.drop("ticker_bucket"))]
        return rows.groupBy(*self.partition_cols(table), "ticker").agg(
            F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), *items)

    def _put(self, counted: DataFrame, table: str, overwrite: str) -> None:
        (counted.hint("rebalance", *self.partition_cols(table)).write.mode("overwrite")
         .option("partitionOverwriteMode", overwrite).partitionBy(*self.partition_cols(table)).parquet(self.profile_path(table)))
        self._profiles.pop(table, None)

    def _reprofile(self, table: str, parts: list[tuple]) -> None:
        """Count the given folders again; one that has no rows any more loses its numbers."""
        rows = self._in_partitions(self.read(table), table, parts)
        left = set(self._touched(rows, table))  # partition columns only
        if left:
            self._put(self._counted(rows, table), table, "dynamic")
        for p in set(parts) - left:
            self._delete("/".join([self.profile_path(table), *(f"{c}={v}" for c, v in zip(self.partition_cols(table), p, strict=True))]))
        self._profiles.pop(table, None)

    def _rebuild_if_behind(self, table: str) -> None:
        fs, mark = self._fs(self._behind(table))
        if fs.exists(mark) or not self._has_files(self.profile_path(table)):
            self._put(self._counted(self.read(table), table), table, "static") if self._has_files(self.path(table)) \
                else self._delete(self.profile_path(table))
            self._delete(self._behind(table))

    def _about_to_change(self, table: str) -> None:
        super()._about_to_change(table)
        self._rebuild_if_behind(table)
        fs, mark = self._fs(self._behind(table))
        fs.create(mark, True).close()

    def _changed(self, table: str, batch: DataFrame, upsert: bool) -> None:
        super()._changed(table, batch, upsert)
        parts = self._touched(batch, table)
        if parts:
            self._reprofile(table, parts)
        self._delete(self._behind(table))

    def delete_ticker(self, tickers) -> int:
        with self._staged(ticker_frame_of(self.spark, tickers)) as gone:
            return self._delete_profiled(gone)

    def _delete_profiled(self, gone: DataFrame) -> int:
        touched = {}
        for table in TABLES:
            held = self.profile(table).join(gone, "ticker", "left_semi")
            touched[table] = self._touched(held, table)
            fs, mark = self._fs(self._behind(table))
            fs.create(mark, True).close()
        affected = super().delete_ticker(gone)
        for table, parts in touched.items():
            if parts:
                self._reprofile(table, parts)
            self._delete(self._behind(table))
        return affected

    # ------------------------------------------------------------------ reports
    def profile(self, table: str) -> DataFrame:
        """(folder columns, ticker, rows, first_day, last_day, n_<item>...)."""
        self._rebuild_if_behind(table)
        if table not in self._profiles:
            empty = self._counted(self.read(table), table)
            if self._has_files(self.profile_path(table)):
                self._profiles[table] = self.spark.read.schema(empty.schema).parquet(self.profile_path(table))
            else:
                self._profiles[table] = empty.limit(0)
        return self._profiles[table]

    def price_profile(self, ref_ticker: str, cutoff: str = "2020-06-01") -> DataFrame:
        """The report of ``quality.price_profile``, added up."""
        is_ref = F.col("ticker") == F.lit(ref_ticker)
        return self.profile("prices").agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.countDistinct("ticker").alias("unique_tickers"),
            F.min("first_day").alias("min_date"), F.max("last_day").alias("max_date"),
            F.coalesce(F.sum(F.when(is_ref, F.col("rows"))), F.lit(0)).alias("ref_rows"),
            F.min(F.when(is_ref, F.col("first_day"))).alias("ref_min_date"),
            F.max(F.when(is_ref, F.col("last_day"))).alias("ref_max_date"),
        ).withColumn("passed", F.coalesce(F.col("min_date") <= F.lit(cutoff).cast("date"), F.lit(False)))

    def fundamentals_profile(self, ref_ticker: str, period: str = "quarterly") -> DataFrame:
        """The report of ``quality.fundamentals_profile``, added up."""
        found = len([c for c in KEY_INCOME_COLUMNS if c in self.read(period).columns])
        return self.profile(period).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.countDistinct("ticker").alias("unique_tickers"),
            F.coalesce(F.sum(F.when(F.col("ticker") == ref_ticker, F.col("rows"))), F.lit(0)).alias("ref_quarters"),
        ).select("*", F.lit(found).cast("bigint").alias("key_columns_found"), F.lit(found >= 2).alias("passed"))

    def filled_shares(self, period: str = "quarterly") -> DataFrame:
        """(item, filled): the share of statement rows with a value, per item."""
        state = self.profile(period)
        items = [c[2:] for c in state.columns if c.startswith("n_")]
        one = state.agg(*[F.try_divide(F.coalesce(F.sum(f"n_{c}"), F.lit(0)), F.sum("rows")).alias(c) for c in items])
        return one.unpivot([], items, "item", "filled")

    def data_summary(self, sample: int = 5) -> DataFrame:
        """The report of ``ingest.data_summary``, added up."""
        prices = self.profile("prices")
        first = (prices.groupBy("ticker").agg(F.min("first_day").alias("a"), F.max("last_day").alias("b"))
                 .orderBy("ticker").limit(sample).selectExpr(
                     "ticker", "date_format(a, 'yyyy-MM-dd') AS min_date", "date_format(b, 'yyyy-MM-dd') AS max_date"))
        return self.spark.sql("""SELECT r.*,
  (SELECT count(DISTINCT ticker) FROM {p}) AS price_tickers,
  (SELECT count(DISTINCT ticker) FROM {q}) AS quarterly_tickers,
  (SELECT count(DISTINCT ticker) FROM {a}) AS annual_tickers
FROM {r} r""", p=prices, q=self.profile("quarterly"), a=self.profile("annual"), r=first)
