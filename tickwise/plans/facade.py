"""A thin facade mirroring the reference's top-level API over a Store.

Single-ticker calls are the set-at-a-time plans restricted to one ticker; the
restriction reaches the scans (bucket directories + Parquet statistics).
Results stay DataFrames; the few scalar accessors collect one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickwise.operators import filters as FL
from tickwise.operators import metrics as M
from tickwise.operators import prices as P
from tickwise.operators import ratios as R
from tickwise.plans import datasets as D
from tickwise.sources import ingest as I
from tickwise.sources.store import Store


class Tickwise:
    def __init__(self, spark: SparkSession, root: str, layout: str = "bucketed", **store_options):
        self.spark = spark
        self.store = Store(spark, root, layout, **store_options)

    # --- data management
    def update_data(self, prices: DataFrame, quarterly: DataFrame | None = None,
                    annual: DataFrame | None = None, tickers=None, start_date=None) -> dict:
        """Full update of ready frames. Without tickers the large-company sample, as far as the
        feed has it; pass ``tickers=prices`` for every ticker of the feed."""
        wanted = I.sample_universe(prices) if tickers is None else tickers
        return I.ingest_full(self.store, prices, quarterly, annual, wanted, start_date)

    def update_from_files(self, prices: str, statements: dict, tickers=None, start_date=None, **options) -> dict:
        """The same from vendor extract files (see ``ingest_extracts``)."""
        if tickers is None:
            feed = I.load_prices_extract(self.spark, prices, options.get("fmt", "csv"), options.get("sep", ";"))
            tickers = I.sample_universe(feed)
        return I.ingest_extracts(self.store, prices, statements, tickers, start_date, **options)

    def update_prices(self, feed: DataFrame, tickers=None) -> dict:
        return I.ingest_incremental(self.store, feed, tickers)

    def list_tickers(self) -> DataFrame:
        return self.store.list_tickers("prices")

    def data_summary(self) -> DataFrame:
        s = self.store
        return I.data_summary(s.scan_prices(), s.scan_fundamentals_quarterly(),
                              s.scan_fundamentals_annual())

    # --- prices
    def get_prices(self, ticker=None, start_date=None, end_date=None, columns=None) -> DataFrame:
        return self.store.scan_prices(ticker, start_date, end_date, columns)

    def get_latest_price(self, ticker: str) -> dict | None:
        row = P.latest_price(self.store.scan_prices(ticker)).first()
        return row.asDict() if row else None

    # --- ratios
    def ratios(self, tickers=None, as_of=None, years: int = 5) -> DataFrame:
        s, tickers = self.store, R.ticker_names(tickers)
        return R.ratio_table(s.scan_prices(tickers), s.scan_fundamentals_quarterly(tickers),
                             tickers, as_of, years)

    def get_ratios(self, ticker: str, as_of=None) -> dict:
        return self.ratios([ticker], as_of).first().asDict()

    def get_pe(self, ticker: str):
        return self.get_ratios(ticker)["pe_ratio"]

    def get_peg(self, ticker: str, years: int = 5):
        return self.ratios([ticker], years=years).first()["peg_ratio"]

    def ratio_panel(self, dates, tickers=None) -> DataFrame:
        s = self.store
        return R.ratio_panel(s.scan_prices(tickers), s.scan_fundamentals_quarterly(tickers),
                             dates, tickers)

    # --- screening & comparison
    def screen(self, tickers=None, **bounds) -> DataFrame:
        return FL.screen_stocks(self.ratios(tickers), FL.screen_bounds(**bounds))

    def compare(self, tickers, metrics=None) -> DataFrame:
        return M.compare_tickers(self.ratios(tickers), metrics)

    def rank(self, metric: str, tickers=None, ascending: bool = True, top_n: int | None = 10):
        return M.rank_by_metric(self.ratios(tickers), metric, ascending, top_n)

    def valuation_summary(self, tickers=None) -> DataFrame:
        s, tickers = self.store, R.ticker_names(tickers)
        return M.valuation_summary(s.scan_prices(tickers), s.scan_fundamentals_quarterly(tickers),
                                   tickers)

    def group_averages(self, members: DataFrame, group_col: str = "group") -> DataFrame:
        return M.group_averages(self.ratios(), members, group_col)

    # --- chart datasets
    def candlestick(self, ticker: str, start_date=None, end_date=None) -> DataFrame:
        return D.candlestick_data(self.store.scan_prices(ticker), start_date, end_date)

    def price_comparison(self, tickers, start_date=None, end_date=None, normalize=False):
        return D.price_comparison_data(self.store.scan_prices(tickers), start_date, end_date, normalize)

    def margin_trend(self, ticker=None) -> DataFrame:
        return D.margin_trend_data(self.store.scan_fundamentals_quarterly(ticker))

    def revenue_earnings(self, ticker=None) -> DataFrame:
        return D.revenue_earnings_data(self.store.scan_fundamentals_quarterly(ticker))

    def ratio_comparison(self, tickers, metrics=None) -> DataFrame:
        return D.ratio_comparison_data(self.ratios(tickers), metrics)

    def ranking(self, metric: str, tickers=None, top_n: int = 10, ascending: bool = True) -> DataFrame:
        return D.ranking_data(self.ratios(tickers), metric, top_n, ascending)

    def group_radar(self, members: DataFrame, group_col: str = "group") -> DataFrame:
        return D.group_radar_data(self.ratios(), members, group_col)

    # --- what is stored
    def has_data(self, tickers) -> DataFrame:
        s = self.store
        return I.has_data(R.ticker_frame_of(self.spark, tickers), s.scan_prices(), s.scan_fundamentals_quarterly(),
                          s.scan_fundamentals_annual())

    def metadata(self, name: str) -> DataFrame:
        return self.store.read_metadata(name)
