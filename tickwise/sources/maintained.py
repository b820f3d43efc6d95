"""Ratio inputs kept up to date by the sinks: a ticker's ratios are then one row to read.

``MaintainedStore`` is a ``Store`` with a state table beside its tables: one row per ticker with the newest close and the
features of the newest quarters, which is all that the ratios and the valuation summary need. Every sink brings it up
to date from its own change set:

* an upsert of prices compares the batch's newest row per ticker with the state's; no stored price is read,
* a replacement of (ticker, year) slices does the same, and reads stored prices only of tickers whose newest row lay in a
  replaced year and is newer than anything in the batch,
* a replacement of statements computes the features of the batch's tickers from the batch, which holds their whole history,
* a deletion drops rows.

Only the state's buckets with changed tickers are rewritten. All of it is aggregates and joins over rows of the batch and
one row per ticker, so a hot ticker is reduced in every task before the shuffle.

A sink that dies between its table and the state leaves a mark; the next reader then builds the state anew from the
tables. So does a batch that brings a new statement item, since an item's mere presence changes the ratios of all
tickers (an absent one gives null, a present one without values 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalar import ticker_bucket
from tickwise.operators.ratios import ratio_projection, restrict, ticker_frame_of, valuation_columns
from tickwise.operators.ttm import latest_features_by_parts
from tickwise.schemas import RATIO_COLUMNS
from tickwise.session import ensure_checkpoint_dir
from tickwise.sources.store import DEALT_JOINS, Store

PRICE_STATE = ["close", "price_date"]


class MaintainedStore(Store):
    """Tables with a state table of ratio inputs; ``years`` is the span of the EPS growth rate."""

    def __init__(self, *args, years: int = 5, **kwargs):
        super().__init__(*args, **kwargs)
        self.years = years
        self._state: DataFrame | None = None

    # ------------------------------------------------------------------ reading
    @property
    def state_path(self) -> str:
        return f"{self.root}/_state/ratio_inputs"

    @property
    def _mark(self) -> str:
        return f"{self.root}/_state/_behind"

    def state(self) -> DataFrame:
        """One row per ticker: newest close and its date, features of the newest quarters, bucket."""
        if self._exists(self._mark) or not self._has_files(self.state_path):
            self.rebuild()
        return self._state_rows()

    def _state_rows(self) -> DataFrame:
        if self._state is None:
            if self._has_files(self.state_path):
                self._state = self.spark.read.parquet(self.state_path)
            else:  # no table holds a row
                self._state = self._recomputed().withColumn("ticker_bucket", F.lit(0)).limit(0)
        return self._state

    def _rows(self, tickers) -> DataFrame:
        """State rows of one ticker, of a list or a frame of them, or of all that have prices."""
        state = self.state()
        if tickers is None:
            return state.where("price_date is not null")
        return ticker_frame_of(self.spark, tickers).join(restrict(state, tickers), "ticker", "left")

    def ratios(self, tickers=None) -> DataFrame:
        """The latest ratio table, read off the state."""
        rows = self._rows(tickers)
        return rows.selectExpr(*ratio_projection(set(rows.columns), self.years, "'latest'"))

    def all_ratios(self, ticker: str) -> DataFrame:
        """The ratios of one ticker: a filter on one bucket's file and a projection."""
        here = self._state_bucket(F.lit(ticker))
        row = self.state().where((F.col("ticker_bucket") == here) & (F.col("ticker") == ticker))
        ratios = row.selectExpr(*ratio_projection(set(row.columns), self.years, "'latest'"))
        # an aggregate over the one state row: an unknown ticker gets a row too
        return ratios.agg(F.lit(ticker).alias("ticker"), F.lit("latest").alias("as_of_date"),
                          *[F.first(c).alias(c) for c in RATIO_COLUMNS])

    def valuation_summary(self, tickers=None) -> DataFrame:
        """Ratios with the newest close and the trailing revenue and net income, read off the state."""
        rows = self._rows(tickers)
        columns = set(rows.columns)
        return rows.selectExpr(*ratio_projection(columns, self.years, "'latest'"), *valuation_columns(columns))

    # ------------------------------------------------------------------ building
    def _features(self, quarterly: DataFrame) -> DataFrame:
        """Of stored rows, or of a batch as it will be stored: tickers are not null there (D13)."""
        return latest_features_by_parts(quarterly.drop("ticker_bucket"), self.years).drop("fiscal_period")

    def _newest(self, prices: DataFrame) -> DataFrame:
        return prices.groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("price_date"))

    def _recomputed(self) -> DataFrame:
        return self._newest(self.read("prices")).join(self._features(self.read("quarterly")), "ticker", "full")

    def rebuild(self) -> None:
        """The state of all tickers from the tables."""
        self._store_state(self._recomputed(), "static")
        self._delete(self._mark)

    def _state_bucket(self, ticker="ticker") -> Column:
        return ticker_bucket(ticker, self.new_buckets)

    def _state_of(self, buckets: list[int]) -> DataFrame:
        """State rows of some buckets, whose numbers a session may read as strings."""
        rows = self._state_rows().where(F.col("ticker_bucket").isin(buckets))
        return rows.withColumn("ticker_bucket", F.col("ticker_bucket").cast("int"))

    def _store_state(self, rows: DataFrame, overwrite: str, moved: bool = True) -> None:
        """Write state rows: all of them (static), or the buckets that they fall into (dynamic).

        A dynamic write may read the buckets that it replaces: they go when it commits. Rows that carry their bucket and
        were not ``moved`` away from its others are written by the tasks that hold them.
        """
        if moved:
            rows = rows.withColumn("ticker_bucket", self._state_bucket()).hint("rebalance", "ticker_bucket")
        (rows.sortWithinPartitions("ticker_bucket", "ticker").write.mode("overwrite").option("compression", "zstd")
         .option("partitionOverwriteMode", overwrite).partitionBy("ticker_bucket").parquet(self.state_path))
        self._state = None

    # ------------------------------------------------------------------ upkeep
    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _about_to_change(self, table: str) -> None:
        super()._about_to_change(table)
        if table == "annual":
            return
        if self._exists(self._mark):  # what an earlier sink left behind is not added to
            self.rebuild()
        fs, p = self._fs(self._mark)
        fs.create(p, True).close()

    def _changed(self, table: str, batch: DataFrame, upsert: bool) -> None:
        super()._changed(table, batch, upsert)
        if table == "annual":
            return
        if not self._has_files(self.state_path):
            self.rebuild()
            return
        if table == "prices":
            self._merge(self._price_changes(batch, upsert), PRICE_STATE, batch)
        else:
            # the batch with all columns of the table, as a reader of the table would see it
            features = self._features(batch.unionByName(self.read(table).limit(0), allowMissingColumns=True))
            known = set(self._state_rows().columns) - {"ticker", "ticker_bucket", *PRICE_STATE}
            if set(features.columns) - {"ticker"} != known:
                self.rebuild()
                return
            self._merge(features, sorted(known), batch)
        self._delete(self._mark)

    def _price_changes(self, batch: DataFrame, upsert: bool) -> DataFrame:
        """(ticker, close, price_date) of the batch's tickers after the sink."""
        new = batch.groupBy("ticker").agg(F.max_by("close", "date").alias("c"), F.max("date").alias("d"),
                                          F.collect_set(F.year("date")).alias("years"))  # a ticker's years
        old = self._state_rows().select("ticker", *PRICE_STATE)
        both = new.join(old, "ticker", "left")
        from_batch = F.expr("price_date is null or d >= price_date")
        if upsert:
            held = F.lit(True)
        else:  # the newest stored row went if its year was replaced
            held = ~F.expr("array_contains(years, year(price_date))")
        known = both.where(from_batch | held).select(
            "ticker", F.when(from_batch, F.col("c")).otherwise(F.col("close")).alias("close"),
            F.when(from_batch, F.col("d")).otherwise(F.col("price_date")).alias("price_date"))
        if upsert:
            return known
        lost = self._kept(both.where(~(from_batch | held)).select("ticker"))
        buckets = [r[0] for r in lost.select(self.bucket_of("ticker", self.buckets("prices"), "prices")).distinct().collect()]
        stored = self.read("prices")
        if "ticker_bucket" in stored.columns:
            stored = stored.where(F.col("ticker_bucket").isin(buckets))  # at most the table's buckets
        return known.unionByName(self._newest(stored.join(lost, "ticker", "left_semi")))

    def _kept(self, df: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(self.spark)
        return df.checkpoint()

    def _merge(self, fresh: DataFrame, columns: list[str], batch: DataFrame) -> None:
        """Give the tickers of ``fresh`` its values in ``columns``; only the buckets of the stored batch's tickers are rewritten.

        ``fresh`` holds tickers of the batch, and is computed once: by the write.
        """
        buckets = [r[0] for r in batch.select(self._state_bucket()).distinct().collect()]
        if not buckets:
            return
        old = self._state_of(buckets)
        new = fresh.select("ticker", self._state_bucket().alias("ticker_bucket"), F.struct(*columns).alias("_new"))
        # both sides are dealt by bucket, so the joined rows lie as they are written
        n = self.new_buckets
        rows = old.repartition(n, "ticker_bucket").join(new.repartition(n, "ticker_bucket"), ["ticker_bucket", "ticker"], "full")
        with self._setting(*DEALT_JOINS):
            self._store_state(rows.select("ticker", *[
                F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                for c in old.columns if c != "ticker"]), "dynamic", moved=False)

    def delete_ticker(self, tickers) -> int:
        self._about_to_change("prices")
        gone = self._kept(ticker_frame_of(self.spark, tickers))
        affected = super().delete_ticker(gone)
        buckets = [r[0] for r in gone.select(self._state_bucket()).distinct().collect()]
        old = self._state_of(buckets)
        marked, few = self._if_few(gone)
        rest = old.join(marked, "ticker", "left_anti")
        left = {r[0] for r in rest.select("ticker_bucket").distinct().collect()}
        if left:  # beside few tickers the rows stay in the tasks that read them
            self._store_state(rest, "dynamic", moved=not few)
        for b in set(buckets) - left:
            self._delete(f"{self.state_path}/ticker_bucket={b}")
        self._state = None
        self._delete(self._mark)
        return affected

    def refresh(self) -> None:
        super().refresh()
        self._state = None
