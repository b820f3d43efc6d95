"""Rows that lie by ticker are written by the tasks that hold them; a batch is gathered once, a rewrite moves rows once at most."""

from __future__ import annotations

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_fewer_moves import _prices, _rows, tables  # noqa: F401
from tickwise.operators.sets import dedupe_keep_last
from tickwise.sources.bridge import Bridge
from tickwise.sources.maintained import MaintainedStore
from tickwise.sources.profiled import ProfiledStore
from tickwise.sources.store import Store
from tickwise.sources.versioned import VersionedStore


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is written into tables."""
    seen, plain = [], Store._layout_for_write

    def kept(self, out, table, moved=True):
        rows = plain(self, out, table, moved)
        seen.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows
    monkeypatch.setattr(Store, "_layout_for_write", kept)
    return seen


@pytest.mark.parametrize("density", ["dense", "medium", "sparse"])
def test_bridge_rows_are_written_where_they_lie(spark, tables, tmp_path, density, plans):  # noqa: F811
    b = Bridge(spark, tables, density).by_ticker()
    st = Store(spark, str(tmp_path / "s"))
    st.write_prices(b.prices(), clustered=True)
    st.write_fundamentals(b.fundamentals(), clustered=True)
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
    st.refresh()
    plain = Bridge(spark, tables, density).prices().where("ticker is not null")  # D13
    assert _rows(st.scan_prices()) == _rows(plain.select(st.scan_prices().columns))


def _to_xxhash(monkeypatch):
    """Tables as they were before the hash was kept with them."""
    monkeypatch.setattr(Store, "_hash", lambda self, table: "xxhash64")
    plain = Store._store_layout

    def without(self, table):
        plain(self, table)
        path = self._layout_path(table)
        with open(path) as f:
            kept = json.load(f)
        del kept["hash"]
        os.remove(os.path.join(os.path.dirname(path), "._layout.json.crc"))
        with open(path, "w") as f:
            json.dump(kept, f)
    monkeypatch.setattr(Store, "_store_layout", without)


@pytest.mark.parametrize("few", [0, 1_000_000])
@pytest.mark.parametrize("kind", [Store, VersionedStore])
@pytest.mark.parametrize("older", [False, True])
def test_rewrites_beside_few_and_many_keys(spark, tmp_path, monkeypatch, few, kind, older):
    root = str(tmp_path / "s")
    with monkeypatch.context() as m:
        if older:
            _to_xxhash(m)
        kind(spark, root, buckets=3).write_prices(_prices(spark, 6))
    monkeypatch.setattr("tickwise.sources.store.FEW_KEYS", few)
    st = kind(spark, root)
    assert st.append_prices(_prices(spark, 9, 2.0).where("ticker <> 'C' and date > '1995-12-31'"))
    st.refresh()
    assert Counter(r.close for r in st.scan_prices().collect()) == {1.0: 10, 2.0: 14}
    assert Counter(r.ticker for r in st.scan_prices(["A", "C"]).collect()) == {"A": 9, "C": 6}
    assert st.write_prices(_prices(spark, 2, 3.0).where("ticker = 'B'")) == 1
    st.refresh()
    assert Counter(r.close for r in st.scan_prices("B").collect()) == {3.0: 2, 2.0: 7}
    st.delete_ticker(spark.createDataFrame([("A",), ("A",), (None,), ("none",)], "ticker string"))
    st.refresh()
    assert Counter(r.ticker for r in st.scan_prices().collect()) == {"B": 9, "C": 6}


def test_a_rewrite_beside_many_keys_moves_each_side_once(spark, tmp_path, monkeypatch, plans):
    monkeypatch.setattr("tickwise.sources.store.FEW_KEYS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        st = Store(spark, str(tmp_path / "s"), buckets=3)
        st.write_prices(_prices(spark, 6))
        plans.clear()
        st.append_prices(_prices(spark, 4, 2.0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [p.count("Exchange") for p in plans if "Join" in p] == [2]
    assert Counter(r.close for r in st.scan_prices().collect()) == {1.0: 6, 2.0: 12}


@pytest.mark.parametrize("kind", [MaintainedStore, ProfiledStore])
def test_states_and_profiles_are_written_without_a_copy(spark, tmp_path, monkeypatch, kind):
    st = kind(spark, str(tmp_path / "s"), buckets=2)
    st.write_prices(_prices(spark, 6))
    staged, plain = [], Store._staged
    monkeypatch.setattr(Store, "_staged", lambda self, df: staged.append(df.columns) or plain(self, df))
    st.append_prices(_prices(spark, 8, 2.0).where("ticker <> 'C'"))
    assert len(staged) == 1  # the batch
    if kind is MaintainedStore:
        assert _rows(st.state().select("ticker", "close")) == Counter({("A", 2.0): 1, ("B", 2.0): 1, ("C", 1.0): 1})
        st.delete_ticker(["A"])
        assert _rows(st.state().select("ticker", "close")) == Counter({("B", 2.0): 1, ("C", 1.0): 1})
    else:
        assert _rows(st.profile("prices").groupBy("ticker").agg(F.sum("rows"))) == Counter({("A", 8): 1, ("B", 8): 1, ("C", 6): 1})


def test_a_unique_order_is_moved_without_the_values(spark):
    rows = spark.createDataFrame([("a", 1, 9.0), ("a", 3, None), ("a", 2, 5.0), ("b", 4, 1.0), (None, 5, 2.0)], "k string, s int, v double")
    got = dedupe_keep_last(rows, ["k"], "s", unique=True)
    assert _rows(got.select("k", "v")) == Counter({("a", None): 1, ("b", 1.0): 1, (None, 2.0): 1})
    assert _rows(got.select("k", "v")) == _rows(dedupe_keep_last(rows, ["k"], "s").select("k", "v"))
