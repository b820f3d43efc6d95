"""Canonical table schemas and vendor column maps.

Item columns are optional per table: a table's schema is the canonical one
restricted to the columns its files carry, because column presence is part
of the ratio semantics (an absent column gives a null ratio, an all-null
column sums to 0).
"""

from __future__ import annotations

from pyspark.sql import types as T

PRICE_KEYS = ["ticker", "date"]
STATEMENT_KEYS = ["ticker", "fiscal_year", "fiscal_period"]

PRICES = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("adjusted_close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("year", T.LongType()),
])

FUNDAMENTALS = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("company_id", T.LongType()),
    T.StructField("fiscal_year", T.LongType(), False),
    T.StructField("fiscal_period", T.DateType(), False),
    T.StructField("fiscal_label", T.StringType()),
    T.StructField("report_date", T.DateType()),
    # income statement
    T.StructField("revenue", T.DoubleType()),
    T.StructField("gross_profit", T.DoubleType()),
    T.StructField("operating_income", T.DoubleType()),
    T.StructField("net_income", T.DoubleType()),
    T.StructField("eps", T.DoubleType()),
    T.StructField("rd_expense", T.DoubleType()),
    # balance sheet
    T.StructField("total_assets", T.DoubleType()),
    T.StructField("total_liabilities", T.DoubleType()),
    T.StructField("shareholders_equity", T.DoubleType()),
    T.StructField("shares_outstanding", T.LongType()),
    # cash flow
    T.StructField("operating_cash_flow", T.DoubleType()),
    T.StructField("capex", T.DoubleType()),
    T.StructField("investing_cash_flow", T.DoubleType()),
    T.StructField("financing_cash_flow", T.DoubleType()),
    T.StructField("free_cash_flow", T.DoubleType()),
])

# Identifier / key columns: carried, never summed by TTM (D3 fix for company_id).
NON_SUMMED = {"ticker", "company_id", "fiscal_year", "fiscal_period", "fiscal_label",
              "report_date", "year", "ticker_bucket"}

# Numeric classes that TTM sums (double, float, bigint, int).
SUMMABLE_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)

RATIO_COLUMNS = ["pe_ratio", "peg_ratio", "operating_margin", "net_profit_margin",
                 "gross_margin", "revenue_growth", "eps_growth", "rd_intensity",
                 "capex_ratio"]

RATIOS = T.StructType(
    [T.StructField("ticker", T.StringType(), False),
     T.StructField("as_of_date", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in RATIO_COLUMNS])

# ---------------------------------------------------------------------------
# Vendor bulk-extract column names -> our names. These must match
# the vendor's published headers exactly, so they are listed verbatim.
# One deliberate difference from a plain pass-through: the vendor's
# "Fiscal Period" is a label ("Q1".."Q4", "FY") that neither sorts by time nor
# compares with a date, so it is kept as ``fiscal_label`` and the period-end
# date ("Report Date") becomes ``fiscal_period``.
# ---------------------------------------------------------------------------
PRICE_COLUMN_MAP = {
    "Ticker": "ticker",
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj. Close": "adjusted_close",
    "Volume": "volume",
}

INCOME_COLUMN_MAP = {
    "Ticker": "ticker",
    "SimFinId": "company_id",
    "Fiscal Year": "fiscal_year",
    "Fiscal Period": "fiscal_label",
    "Report Date": "fiscal_period",
    "Revenue": "revenue",
    "Gross Profit": "gross_profit",
    "Operating Income (Loss)": "operating_income",
    "Net Income": "net_income",
    "Earnings Per Share, Diluted": "eps",
    "Research & Development": "rd_expense",
    # test-fixture spelling of the R&D item (D22)
    "research_development": "rd_expense",
}

BALANCE_COLUMN_MAP = {
    "Ticker": "ticker",
    "SimFinId": "company_id",
    "Fiscal Year": "fiscal_year",
    "Fiscal Period": "fiscal_label",
    "Report Date": "fiscal_period",
    "Total Assets": "total_assets",
    "Total Liabilities": "total_liabilities",
    "Total Equity": "shareholders_equity",
    "Shares (Diluted)": "shares_outstanding",
}

CASHFLOW_COLUMN_MAP = {
    "Ticker": "ticker",
    "SimFinId": "company_id",
    "Fiscal Year": "fiscal_year",
    "Fiscal Period": "fiscal_label",
    "Report Date": "fiscal_period",
    "Net Cash from Operating Activities": "operating_cash_flow",
    "Change in Fixed Assets & Intangibles": "capex",
    "Net Cash from Investing Activities": "investing_cash_flow",
    "Net Cash from Financing Activities": "financing_cash_flow",
}

# Fixed values below, as the reference has them.
# Ticker aliases tried when the original symbol is absent from the feed.
TICKER_ALIASES = {"GOOGL": "GOOG", "BRK.B": "BRK-B"}

# Large-company sample that an update without a ticker list is resolved from (fixed values).
SAMPLE_UNIVERSE = [
    "AAPL", "MSFT", "AMZN", "NVDA", "GOOGL", "META", "TSLA", "BRK.B", "UNH", "JNJ", "JPM", "V", "PG", "XOM",
    "HD", "CVX", "MA", "ABBV", "MRK", "LLY", "PFE", "KO", "PEP", "COST", "AVGO", "TMO", "MCD", "WMT", "CSCO",
    "ACN", "ABT", "DHR", "NEE", "VZ", "ADBE", "NKE", "TXN", "PM", "CMCSA", "CRM", "INTC", "AMD", "ORCL",
    "IBM", "QCOM", "HON", "UNP", "LOW", "AMGN", "SBUX",
]

# Default first date kept by a full ingest.
DEFAULT_START_DATE = "2020-01-01"

