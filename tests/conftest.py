"""Shared fixtures: one local Spark session, a temp store, the reference's sample frames."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickwise.session import get_spark  # noqa: E402
from tickwise.sources.extracts import conform_fundamentals  # noqa: E402
from tickwise.sources.store import Store  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("local[4]", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")),
        "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "data"))


@pytest.fixture
def ticker_store(spark, tmp_path):
    return Store(spark, str(tmp_path / "data_t"), layout="ticker")


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


PRICE_SCHEMA = ("date date, open double, high double, low double, close double, "
                "adjusted_close double, volume bigint")


@pytest.fixture
def sample_prices_df(spark):
    rows = [
        (d("2024-01-02"), 150.0, 152.0, 149.0, 151.0, 150.5, 1000000),
        (d("2024-01-03"), 151.0, 153.0, 150.0, 152.0, 151.5, 1100000),
        (d("2024-01-04"), 152.0, 154.0, 151.0, 151.5, 151.0, 1050000),
        (d("2024-01-05"), 151.5, 153.0, 150.0, 152.5, 152.0, 1200000),
        (d("2024-01-08"), 153.0, 155.0, 152.0, 154.0, 153.5, 1150000),
        (d("2024-01-09"), 154.0, 156.0, 153.0, 155.0, 154.5, 1300000),
    ]
    return spark.createDataFrame(rows, PRICE_SCHEMA)


@pytest.fixture
def sample_fundamentals_df(spark):
    rows = [
        (d("2023-03-31"), 2023, 100000.0, 40000.0, 25000.0, 20000.0, 2.0, 5000.0),
        (d("2023-06-30"), 2023, 110000.0, 44000.0, 27000.0, 22000.0, 2.2, 5500.0),
        (d("2023-09-30"), 2023, 105000.0, 42000.0, 26000.0, 21000.0, 2.1, 5200.0),
        (d("2023-12-31"), 2023, 120000.0, 48000.0, 30000.0, 25000.0, 2.5, 6000.0),
    ]
    df = spark.createDataFrame(rows, "fiscal_period date, fiscal_year bigint, revenue double, "
                                     "gross_profit double, operating_income double, "
                                     "net_income double, eps double, research_development double")
    return conform_fundamentals(df)  # research_development -> rd_expense (D22)
