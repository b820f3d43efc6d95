"""Incremental prices as a stream: the strict late rule with a state of the newest day per ticker.

Feed files are drained in micro-batches. A row is on time if its ticker is stored and its day is after the newest day
that the ticker had when the batch began; it goes to the price table. Every other row is late (or of an unknown ticker) and goes to
a table of its own with the day it came too late for, so nothing is lost and a user can count or replay it.

The newest day per ticker is keyed state in the shared folder, one small table per micro-batch: batch N reads
what batch N-1 left and writes its own. A batch that is replayed after a failure therefore judges its rows as before,
whatever it had already written: the upsert is idempotent, late rows and state of a batch are overwritten as a whole. So a
stream that stops anywhere and starts again ends with the tables of a run without the stop.

With ``dedupe_within`` rows that the vendor sends again, in this or a later batch, are dropped by Spark's own state
(``dropDuplicatesWithinWatermark`` on ticker and day) before they are judged; that state ends that span behind the newest day
seen, and rows further behind are dropped and counted in the query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickwise.schemas import PRICES
from tickwise.sources.store import Store

LATE = "late_for date, reason string, epoch bigint"


class IncrementalStream:
    """A price feed folder that is drained into ``store``; ``work`` is a shared folder for state, late rows and checkpoint."""

    def __init__(self, spark: SparkSession, store: Store, feed_dir: str, work: str, schema=None,
                 dedupe_within: str | None = None, max_files: int | None = None):
        self.spark, self.store, self.feed_dir, self.work = spark, store, feed_dir, work.rstrip("/")
        self.schema, self.dedupe_within, self.max_files = schema or PRICES, dedupe_within, max_files

    def start(self, available_now: bool = True) -> StreamingQuery:
        """Start the stream; with ``available_now`` it takes the files that are there and ends."""
        reader = self.spark.readStream.schema(self.schema)
        if self.max_files:
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        rows = reader.parquet(self.feed_dir)
        if self.dedupe_within:
            rows = (rows.withColumn("_day", F.col("date").cast("timestamp")).withWatermark("_day", self.dedupe_within)
                    .dropDuplicatesWithinWatermark(["ticker", "date"]).drop("_day"))
        writer = rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.work}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()

    # ------------------------------------------------------------------ state
    def _epochs(self) -> list[int]:
        fs, p = self.store._fs(f"{self.work}/newest")
        if not fs.exists(p):
            return []
        return sorted(int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(p)
                      if "=" in st.getPath().getName() and fs.exists(self.store._fs(f"{st.getPath()}/_SUCCESS")[1]))

    def newest(self, before: int) -> DataFrame:
        """(ticker, newest): the newest day of each stored ticker when micro-batch ``before`` begins."""
        known = [e for e in self._epochs() if e < before]
        if not known:  # what the table holds before the stream's first batch
            first = f"{self.work}/newest/epoch=-1"
            (self.store.read("prices").groupBy("ticker").agg(F.max("date").alias("newest"))
             .write.mode("overwrite").parquet(first))
            return self.spark.read.schema("ticker string, newest date").parquet(first)
        return self.spark.read.schema("ticker string, newest date").parquet(f"{self.work}/newest/epoch={known[-1]}")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch: judge, store, keep late rows, leave the state for the next."""
        store = self.store
        known = self.newest(epoch)
        with store._staged(batch) as rows:  # the feed is read once; both sides of the join are stored
            judged = rows.join(known, "ticker", "left")
            on_time = judged.where("date > newest").drop("newest")
            late = (judged.where("not coalesce(date > newest, false)")
                    .withColumn("reason", F.expr("""case when ticker is null or date is null then 'no key'
                                                         when newest is null then 'unknown ticker' else 'late' end"""))
                    .withColumnRenamed("newest", "late_for"))
            store.append_prices(on_time)
            late.write.mode("overwrite").parquet(f"{self.work}/late/epoch={epoch}")
            fresh = on_time.groupBy("ticker").agg(F.max("date").alias("newest"))
            (known.union(fresh.select("ticker", "newest")).groupBy("ticker").agg(F.max("newest").alias("newest"))
             .write.mode("overwrite").parquet(f"{self.work}/newest/epoch={epoch}"))
        for old in [e for e in self._epochs() if e < epoch - 1]:  # the one before is kept for a replay
            store._delete(f"{self.work}/newest/epoch={old}")

    def late_rows(self) -> DataFrame:
        """All rows that were not stored: the feed's columns, ``late_for``, ``reason`` and the micro-batch."""
        path = f"{self.work}/late"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        if not self.store._has_files(path):
            return self.spark.createDataFrame([], f"{columns}, {LATE}")
        return self.spark.read.schema(f"{columns}, {LATE}").parquet(path)
