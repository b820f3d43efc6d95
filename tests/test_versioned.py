"""Versioned tables: file-level rewrites, one commit over tables, earlier versions, conflicts."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tickwise.schemas import PRICES
from tickwise.sources.ingest import ingest_full
from tickwise.sources.store import Store
from tickwise.sources.versioned import CommitConflict, VersionedStore


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _prices(spark, rng, n=60, tickers=9):
    rows = {}
    for _ in range(n):
        day = dt.date(rng.randint(2019, 2021), rng.randint(1, 12), rng.randint(1, 28))
        c = round(rng.uniform(1, 90), 2)
        t = f"T{rng.randint(0, tickers - 1)}"
        rows[t, day] = (t, day, c, c, c, c, c, 10, day.year)
    return spark.createDataFrame(list(rows.values()), PRICES)


def _quarters(spark, k):
    rows = [(f"T{t}", 2020, dt.date(2020, 3, 31), float(t + k)) for t in range(4)]
    return spark.createDataFrame(rows, "ticker string, fiscal_year bigint, fiscal_period date, revenue double")


@pytest.fixture
def versioned(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "versioned"), buckets=2)


@pytest.mark.parametrize("seed", [1, 2])
def test_sinks_agree_with_the_plain_store(spark, versioned, tmp_path, seed):
    plain, rng = Store(spark, str(tmp_path / "plain"), buckets=2), random.Random(seed)
    for step in range(6):
        kind = rng.choice(["append", "write", "delete", "wide"]) if step else "write"
        batch = _prices(spark, rng, 30)
        if kind == "wide":
            batch = batch.withColumn("note", F.lit(f"n{step}"))
        gone = [f"T{rng.randint(0, 8)}", "T99"]
        for st in (plain, versioned):
            if kind == "delete":
                st.delete_ticker(gone)
            elif kind == "write":
                st.write_prices(batch)
            else:
                st.append_prices(batch)
        assert _rows(versioned.scan_prices()) == _rows(plain.scan_prices()), kind
    assert _rows(VersionedStore(spark, versioned.root).scan_prices()) == _rows(plain.scan_prices())


def test_a_late_correction_rewrites_one_file(spark, versioned):
    rng = random.Random(4)
    for i in range(5):  # appended day by day, a (year, bucket) folder gets many files
        day = _prices(spark, rng, 40).withColumn("date", F.date_add("date", i * 1100)).drop("year")
        versioned.append_prices(day.withColumn("date", F.make_date(F.lit(2020), F.lit(1 + 2 * i), F.dayofmonth("date") % 28 + 1))
                                .dropDuplicates(["ticker", "date"]))
    files = versioned._live("prices")
    assert len({os.path.dirname(f).split("/", 1)[1] for f in files}) == 2 and len(files) >= 10
    one = versioned.scan_prices().orderBy("date", "ticker").first()
    fix = spark.createDataFrame([(one.ticker, one.date, 1.0, 1.0, 1.0, 777.0, 1.0, 1, one.year)], PRICES)
    before = versioned.scan_prices().count()
    versioned.append_prices(fix)
    assert versioned.last_commit["prices"] == {"added": 1, "removed": 1}
    assert len(set(files) - set(versioned._live("prices"))) == 1
    assert versioned.scan_prices().count() == before
    assert versioned.scan_prices(one.ticker).where(F.col("date") == one.date).first().close == 777.0
    versioned.append_prices(fix.withColumn("date", F.lit(dt.date(2020, 12, 31))))  # a new day rewrites nothing
    assert versioned.last_commit["prices"] == {"added": 1, "removed": 0}


def test_a_file_tells_which_tickers_it_cannot_hold(spark, versioned):
    """Each row group has a Bloom filter of its tickers, or a dictionary that Parquet consults alike."""
    versioned.write_prices(_prices(spark, random.Random(1)))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in versioned._live("prices"):
        path = jvm.org.apache.hadoop.fs.Path(f"{versioned.path('prices')}/{name}")
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        for block in reader.getFooter().getBlocks():
            column = next(c for c in block.getColumns() if c.getPath().toDotString() == "ticker")
            assert column.getBloomFilterOffset() > 0 or column.hasDictionaryPage()
        reader.close()
    plan = versioned.scan_prices("T1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ticker,T1)" in plan


def test_a_failure_between_tables_leaves_the_old_state(spark, versioned):
    rng = random.Random(7)
    first = _prices(spark, rng).checkpoint()
    ingest_full(versioned, first, _quarters(spark, 0), _quarters(spark, 0), start_date="2010-01-01")
    assert versioned.versions() == [1]
    old = _rows(versioned.scan_prices()), _rows(versioned.scan_fundamentals_quarterly())
    broken = _quarters(spark, 5).withColumn("fiscal_period", F.raise_error(F.lit("stop")).cast("date"))
    with pytest.raises(Exception, match="stop"):
        ingest_full(versioned, first.withColumn("close", F.lit(0.0)), _quarters(spark, 9), broken, start_date="2010-01-01")
    for st in (versioned, VersionedStore(spark, versioned.root)):
        assert (_rows(st.scan_prices()), _rows(st.scan_fundamentals_quarterly())) == old and st.versions() == [1]
    ingest_full(versioned, first.withColumn("close", F.lit(0.0)), _quarters(spark, 9), None, start_date="2010-01-01")
    assert versioned.versions() == [1, 2] and versioned.scan_prices().where("close <> 0").count() == 0
    past = VersionedStore(spark, versioned.root, version=1)
    assert (_rows(past.scan_prices()), _rows(past.scan_fundamentals_quarterly())) == old
    with pytest.raises(ValueError):
        past.append_prices(first)
    assert versioned.vacuum() > 0 and versioned.versions() == [2]
    versioned.refresh()
    assert versioned.scan_prices().count() == first.count()


def test_of_two_writers_the_second_is_told(spark, versioned):
    rng = random.Random(9)
    versioned.write_prices(_prices(spark, rng))
    other = VersionedStore(spark, versioned.root, buckets=2)
    other.scan_prices().count()
    versioned.append_prices(_prices(spark, rng, 5))
    kept = _rows(versioned.scan_prices())
    with pytest.raises(CommitConflict):
        other.append_prices(_prices(spark, rng, 5))
    assert _rows(VersionedStore(spark, versioned.root).scan_prices()) == kept
    other.append_prices(_prices(spark, rng, 5))  # it has seen the newest version now
    assert other.versions() == [1, 2, 3]
