from tickwise.functions.scalar import (  # noqa: F401
    add_ticker_column, candle_colour, free_cash_flow, metric_label, parse_iso_date,
    quarter_end, round_2, round_4, safe_div, ticker_bucket, year_of_date,
)
