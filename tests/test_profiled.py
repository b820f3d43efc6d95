"""Profiles that sinks keep equal full runs; only touched folders are read."""

from __future__ import annotations

import random

import pytest

from tests.test_maintained import FQ, _prices, _quarters, _rows
from tickwise.operators import quality as Q
from tickwise.operators import ratios as R
from tickwise.sources.ingest import data_summary
from tickwise.sources.maintained import MaintainedStore
from tickwise.sources.profiled import ProfiledStore


class Both(MaintainedStore, ProfiledStore):
    """State and profiles of the same tables."""


def _agree(st):
    px, fq = st.scan_prices(), st.scan_fundamentals_quarterly()
    for t in ("T1", "nope"):
        assert _rows(st.price_profile(t)) == _rows(Q.price_profile(px, t))
        assert _rows(st.fundamentals_profile(t)) == _rows(Q.fundamentals_profile(fq, t))
    assert _rows(st.data_summary(3)) == _rows(data_summary(px, fq, st.scan_fundamentals_annual(), 3))
    n = fq.count()
    for r in st.filled_shares().collect():
        assert r.filled == (fq.where(f"{r.item} is not null").count() / n if n else None)


@pytest.mark.parametrize("kind", [ProfiledStore, Both])
def test_random_sinks(spark, tmp_path, kind):
    st, rng = kind(spark, str(tmp_path / "p"), buckets=3), random.Random(3)
    columns = [c.split()[0] for c in FQ.split(", ")]
    st.write_prices(_prices(spark, rng))
    for step in range(6):
        pick = rng.choice(["append", "write", "quarters", "delete"]) if step else "quarters"
        if pick == "append":
            st.append_prices(_prices(spark, rng, 5))
        elif pick == "write":
            st.write_prices(_prices(spark, rng, 4))
        elif pick == "quarters":
            st.write_fundamentals(_quarters(spark, rng, columns))
        else:
            st.delete_ticker([f"T{rng.randint(0, 6)}", "T99"])
    _agree(st)
    again = kind(spark, st.root, buckets=3)
    _agree(again)
    if kind is Both:
        assert _rows(again.ratios()) == _rows(R.ratio_table(again.scan_prices(), again.scan_fundamentals_quarterly()))


def test_an_upsert_reads_touched_folders_only(spark, tmp_path, monkeypatch):
    st, rng = ProfiledStore(spark, str(tmp_path / "p"), buckets=3), random.Random(6)
    st.write_prices(_prices(spark, rng, 60))
    read = []
    counted = ProfiledStore._counted
    monkeypatch.setattr(ProfiledStore, "_counted", lambda self, rows, table: read.append(
        [tuple(r) for r in rows.select("year", "ticker_bucket").distinct().collect()]) or counted(self, rows, table))
    fix = _prices(spark, rng, 2).checkpoint()
    st.append_prices(fix)
    touched = {(r.year, r[1]) for r in fix.select("year", st.bucket_of("ticker", 3)).collect()}
    assert read and all(set(x) <= touched for x in read)
    monkeypatch.undo()
    _agree(st)


def test_a_sink_that_dies_before_the_profile(spark, tmp_path, monkeypatch):
    st, rng = ProfiledStore(spark, str(tmp_path / "p"), buckets=3), random.Random(7)
    st.write_prices(_prices(spark, rng, 20))
    monkeypatch.setattr(ProfiledStore, "_reprofile", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        st.append_prices(_prices(spark, rng, 9))
    monkeypatch.undo()
    _agree(ProfiledStore(spark, st.root, buckets=3))
