"""Streaming form of the price upsert: new feed files are merged as they land.

``readStream`` over a folder of Parquet feed files, each micro-batch applied
with ``Store.append_prices`` (newest source wins per (ticker, date)) inside
``foreachBatch``. The stream checkpoint records which files were applied, so
a restarted query resumes without re-applying or skipping a batch; the
upsert itself is idempotent, so a batch replayed after a failure between
write and commit leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickwise.schemas import PRICES
from tickwise.sources.store import Store


def start_price_upsert(spark: SparkSession, store: Store, feed_dir: str, checkpoint: str,
                       available_now: bool = True, schema=None) -> StreamingQuery:
    """Start the upsert stream; with ``available_now`` it drains the folder and stops."""
    feed_schema = schema or PRICES
    stream = spark.readStream.schema(feed_schema).parquet(feed_dir)

    def apply(batch: DataFrame, _epoch: int) -> None:
        store.append_prices(batch)  # stages the batch, so its files are read once

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
