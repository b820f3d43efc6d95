"""The streaming upsert drains a feed folder into the store with the batch semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import PRICE_SCHEMA, d
from tickwise.schemas import PRICES
from tickwise.sources.ingest import ingest_incremental
from tickwise.sources.store import Store
from tickwise.streaming.incremental import IncrementalStream
from tickwise.streaming.upsert import start_price_upsert


def test_stream_upsert(spark, store, sample_prices_df, tmp_path):
    store.write_prices(sample_prices_df, "AAPL")
    feed_dir = str(tmp_path / "feed")
    batch1 = spark.createDataFrame([(d("2024-01-09"), 1.0, 1.0, 1.0, 999.0, 1.0, 1)], PRICE_SCHEMA)
    batch2 = spark.createDataFrame([(d("2024-01-10"), 1.0, 1.0, 1.0, 157.0, 1.0, 1)], PRICE_SCHEMA)
    for b in (batch1, batch2):
        (b.withColumn("ticker", F.lit("AAPL")).withColumn("year", F.lit(2024).cast("bigint"))
         .write.mode("append").parquet(feed_dir))
    q = start_price_upsert(spark, store, feed_dir, str(tmp_path / "stream-ckpt"))
    q.awaitTermination(120)
    df = store.scan_prices("AAPL")
    assert df.count() == 7
    assert df.where(F.col("date") == d("2024-01-09")).first().close == 999.0


def _feed(spark, path, rows):
    spark.createDataFrame([(t, d(x), c, c, c, c, c, 1, int(x[:4])) for t, x, c in rows], PRICES).coalesce(1).write.mode(
        "append").parquet(path)


BATCHES = [[("A", "2024-01-03", 2.0), ("A", "2024-01-02", 9.0), ("Z", "2024-01-03", 5.0)],
           [("A", "2024-01-04", 3.0), ("B", "2024-01-02", 7.0), ("B", "2024-01-05", 1.5), ("A", "2024-01-03", 8.0)],
           [("B", "2024-01-05", 6.0), ("B", "2024-01-06", 1.6), ("A", "2024-01-04", 9.0)]]
STORED = [("A", "2024-01-02", 1.0), ("B", "2024-01-03", 1.0)]


def _shown(df):
    return sorted((r.ticker, str(r.date), r.close) for r in df.collect())


def test_incremental_stream_survives_stops(spark, tmp_path, monkeypatch):
    """Stopped before, in and after a batch, the stream ends as the batch job does; late rows are kept and counted."""
    plain, live = (Store(spark, str(tmp_path / n)) for n in ("plain", "live"))
    first = str(tmp_path / "first")
    _feed(spark, first, STORED)
    for st in (plain, live):
        st.write_prices(spark.read.parquet(first))
    late = 0
    for i, rows in enumerate(BATCHES):
        path = str(tmp_path / f"feed{i}")
        _feed(spark, path, rows)
        before = plain.scan_prices().count()
        ingest_incremental(plain, spark.read.parquet(path))
        plain.refresh()
        late += len(rows) - (plain.scan_prices().count() - before)

    feed, work = str(tmp_path / "feed"), str(tmp_path / "work")
    stream = IncrementalStream(spark, live, feed, work)
    _feed(spark, feed, BATCHES[0])
    stream.start().awaitTermination(120)
    _feed(spark, feed, BATCHES[1])
    # dies after the prices were stored, before late rows and state
    append = Store.append_prices
    monkeypatch.setattr(Store, "append_prices", lambda self, df: (append(self, df), 1 / 0))
    try:
        stream.start().awaitTermination(120)
        raise AssertionError("the batch should have failed")
    except Exception as e:  # noqa: BLE001
        assert "ZeroDivisionError" in str(e)
    monkeypatch.undo()
    again = IncrementalStream(spark, Store(spark, live.root), feed, work)
    again.start().awaitTermination(120)
    _feed(spark, feed, BATCHES[2])
    again.start().awaitTermination(120)
    live.refresh()
    assert _shown(live.scan_prices()) == _shown(plain.scan_prices())
    rows = again.late_rows().collect()
    assert len(rows) == late == 6
    assert sorted((r.ticker, str(r.date), str(r.late_for), r.reason) for r in rows) == [
        ("A", "2024-01-02", "2024-01-02", "late"), ("A", "2024-01-03", "2024-01-03", "late"), ("A", "2024-01-04", "2024-01-04", "late"),
        ("B", "2024-01-02", "2024-01-03", "late"), ("B", "2024-01-05", "2024-01-05", "late"),
        ("Z", "2024-01-03", "None", "unknown ticker")]


def test_rows_sent_again_are_dropped_within_the_watermark(spark, store, tmp_path):
    feed = str(tmp_path / "feed")
    _feed(spark, str(tmp_path / "first"), STORED)
    store.write_prices(spark.read.parquet(str(tmp_path / "first")))
    stream = IncrementalStream(spark, store, feed, str(tmp_path / "work"), dedupe_within="30 days")
    for _ in range(2):  # the same rows arrive twice
        _feed(spark, feed, [("A", "2024-01-05", 2.0), ("A", "2024-01-06", 2.0)])
        stream.start().awaitTermination(120)
    store.refresh()
    assert store.scan_prices("A").count() == 3 and stream.late_rows().count() == 0
