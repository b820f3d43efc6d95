"""Rejected rows of vendor files, and the order of rows in files."""

from __future__ import annotations

import pytest

from tickwise.operators.sets import source_position
from tickwise.sources import extracts as X
from tickwise.sources.store import Store

CSV = """Ticker;Date;Open;High;Low;Close;Adj. Close;Volume
A;2024-01-02;1.0;2.0;0.5;1.5;1.5;100
A;not a day;1.0;2.0;0.5;1.5;1.5;100
;2024-01-03;1.0;2.0;0.5;1.5;1.5;100
B;2024-01-02;one;2.0;0.5;x;1.5;100
B;2024-01-03;;2.0;0.5;1.5;1.5;
B;2024-01-04;1.0
C;2024-01-04;1.0;2.0;0.5;1.5;1.5;7;extra
A;2024-01-02;1.0;2.0;0.5;9.5;1.5;100
"""


def test_rejects_carry_row_and_reason(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text(CSV)
    got = X.load_with_rejects(spark, str(path), "prices", str(tmp_path / "loaded"))
    assert (got.n_rows, got.n_rejects) == (3, 5)
    why = {r.raw: list(r.reasons) for r in got.rejects.collect()}
    assert all(r.file.endswith("prices.csv") for r in got.rejects.collect())
    assert sorted(why.values()) == [["date: malformed"], ["open: malformed", "close: malformed"], ["ticker: missing"],
                                    ["wrong number of fields"], ["wrong number of fields"]]
    assert "B;2024-01-04;1.0" in why and any('"not a day"' in raw for raw in why)
    plain = X.load_prices_extract(spark, str(path))
    assert got.rows.schema.simpleString() == plain.schema.simpleString()
    good = plain.where("ticker is not null and date is not null and close is not null and volume is distinct from 7 "
                       "and not (ticker = 'B' and date = '2024-01-04')")
    assert sorted(map(str, got.rows.collect())) == sorted(map(str, good.collect()))


def test_a_clean_and_an_empty_file(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("\n".join(CSV.split("\n")[:2]))
    got = X.load_with_rejects(spark, str(path), "prices", str(tmp_path / "a"))
    assert (got.n_rows, got.n_rejects) == (1, 0) and got.rejects.count() == 0 and got.rows.count() == 1
    path.write_text(CSV.split("\n")[0] + "\n")
    got = X.load_with_rejects(spark, str(path), "prices", str(tmp_path / "b"))
    assert (got.n_rows, got.n_rejects) == (0, 0)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_the_last_row_of_the_files_is_stored(spark, tmp_path, fmt):
    path = tmp_path / "prices.csv"
    path.write_text(CSV)
    feed = X.load_prices_extract(spark, str(path))
    if fmt == "parquet":  # the row that comes last in the files has the smaller close
        feed = feed.where("ticker = 'A' and date is not null")
        feed.where("close > 9").coalesce(1).write.parquet(str(tmp_path / "in/1"))
        feed.where("close < 9").coalesce(1).write.parquet(str(tmp_path / "in/2"))
        feed = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    st = Store(spark, str(tmp_path / "data"))
    st.append_prices(feed.where("ticker = 'A'"))
    assert [r.close for r in st.scan_prices("A").collect()] == [9.5 if fmt == "csv" else 1.5]


def test_frames_that_are_no_scans_have_no_position(spark):
    df = spark.createDataFrame([("A", 1)], "ticker string, v int")
    assert source_position(df) is None and source_position(df.groupBy("ticker").count()) is None
