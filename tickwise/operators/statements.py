"""Combining the three statements into one fundamentals frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickwise.functions.scalar import free_cash_flow
from tickwise.schemas import STATEMENT_KEYS


def combine_statements(income: DataFrame, balance: DataFrame | None = None,
                       cashflow: DataFrame | None = None,
                       keys: list[str] | None = None) -> DataFrame:
    """income LEFT JOIN balance LEFT JOIN cashflow on ticker, year and period label.

    The vendor's label (Q1, FY) names the period; report dates of one period may differ between
    statements, so they join only frames without a label (D5). Income's columns win over those
    of the same name, which are pruned before the join. Null keys never match; duplicate right
    keys fan out. No income rows means an empty result.
    """
    frames = [f for f in (income, balance, cashflow) if f is not None]
    if keys is None:
        labelled = all("fiscal_label" in f.columns for f in frames)
        keys = ["ticker", "fiscal_year", "fiscal_label"] if labelled else STATEMENT_KEYS
    df = income
    for right in frames[1:]:
        wanted = [c for c in right.columns if c in keys or c not in df.columns]
        df = df.join(right.select(*wanted), keys, "left")
    if {"operating_cash_flow", "capex"} <= set(df.columns):
        df = df.withColumn("free_cash_flow", free_cash_flow())
    return df
