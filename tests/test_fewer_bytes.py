"""What is moved and written is no wider than needed: features by parts, the state's merge, vendor files, bridge rows."""

from __future__ import annotations

import datetime as dt
import glob
import random
from collections import Counter

import pytest

from tests.test_fewer_moves import _rows, tables  # noqa: F401
from tickwise.operators.ttm import latest_features, latest_features_by_parts
from tickwise.plans import registry
from tickwise.schemas import PRICES
from tickwise.sources.bridge import Bridge
from tickwise.sources.maintained import MaintainedStore

ITEMS = ["revenue", "net_income", "gross_profit", "capex"]


def _quarters(spark, sizes):
    rng = random.Random(3)
    rows = [(f"T{n}", dt.date(2000 + k // 4, 3 * (k % 4) + 1, 28), *(rng.choice([None, rng.uniform(1, 99)]) for _ in ITEMS),
             rng.randint(1, 9)) for n in sizes for k in range(n)]
    return spark.createDataFrame(rows, "ticker string, fiscal_period date, " + ", ".join(f"{c} double" for c in ITEMS)
                                 + ", shares_outstanding bigint")


@pytest.mark.parametrize("years", [1, 2, 5])
@pytest.mark.parametrize("without", [[], ["shares_outstanding"], ["revenue"], [*ITEMS, "shares_outstanding"]])
def test_features_by_parts(spark, years, without):
    q = _quarters(spark, [1, 3, 4, 5, 7, 8, 16, 17, 19, 20, 21, 30]).drop(*without)
    got, want = latest_features_by_parts(q, years), latest_features(q, years)
    assert got.dtypes == want.dtypes and _rows(got) == _rows(want)
    assert latest_features_by_parts(q.limit(0), years).count() == 0


def test_old_quarters_of_the_state_are_moved_with_their_eps_alone(spark, tmp_path):
    st = MaintainedStore(spark, str(tmp_path / "m"), buckets=2)
    st.write_fundamentals(_quarters(spark, [3, 24]))
    plan = st._features(st.read("quarterly"))._jdf.queryExecution().sparkPlan().toString().split("\n")
    limits = [i for i, line in enumerate(plan) if "WindowGroupLimit" in line and "Partial" in line]
    wide = [i for i in limits if any("gross_profit" in line for line in plan[i + 1:i + 3])]
    assert len(limits) == 2 and len(wide) == 1 and ", 5, Partial" in plan[wide[0]]


def test_a_merge_of_the_state_stores_its_change_once(spark, tmp_path, monkeypatch):
    st = MaintainedStore(spark, str(tmp_path / "m"), buckets=2)
    px = spark.createDataFrame([(f"T{k}", dt.date(2020, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, 5, 2020) for k in range(6)], PRICES)
    st.write_prices(px)
    st.write_fundamentals(_quarters(spark, [3, 4]))
    kept = []
    monkeypatch.setattr(MaintainedStore, "_kept", lambda self, df: kept.append(df) or df)
    st.append_prices(px.selectExpr("ticker", "date_add(date, 1) date", "close + 1 close"))
    st.write_fundamentals(_quarters(spark, [4, 5]))
    assert not kept
    assert {r.ticker: r.close for r in st.state().where("close is not null").collect()} == {f"T{k}": 2.0 for k in range(6)}
    assert {r.ticker: r.n_quarters for r in st.state().where("n_quarters is not null").collect()} == {"T3": 3, "T4": 4, "T5": 5}


def test_vendor_files_of_ingest_full_are_compressed(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    made = Counter()

    def here(_spark, name):
        made[name] += 1
        return f"{tmp_path}/{name}"
    monkeypatch.setattr(registry, "shared_dir", here)
    got = registry.QUERIES["ingest_full"](spark, tables).first()
    vendor = [n for n in made if n.startswith("vendor-")]
    assert len(vendor) == 7 and got.fundamentals_written == got.stored_quarterly_rows > 0
    for n in vendor:
        parts = glob.glob(f"{tmp_path}/{n}/part-*")
        assert parts and all(p.endswith(".csv.gz") for p in parts)


@pytest.mark.parametrize("density", ["dense", "sparse"])
def test_bridge_rows_carry_days(spark, tables, density):  # noqa: F811
    b = Bridge(spark, tables, density).by_ticker()
    assert "cast(l_shipdate" not in b.rows._jdf.queryExecution().executedPlan().toString()
    plain = Bridge(spark, tables, density)
    assert _rows(b.prices()) == _rows(plain.prices()) and _rows(b.fundamentals()) == _rows(plain.fundamentals())
