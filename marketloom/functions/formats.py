"""Report text for numbers, with 'N/A' for nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.rules import industry_label

# Which report columns are percentages, prices or whole numbers.
PERCENT_COLUMNS = (
    "revenue_yoy", "revenue_mom", "daily_return", "monthly_return", "volatility_20d", "dividend_yield",
    "roe", "roa", "gross_margin", "operating_margin", "debt_ratio",
)
PRICE_COLUMNS = (
    "close_price", "open_price", "high_price", "low_price", "price_change", "pe_ratio", "eps", "current_ratio",
)
WHOLE_COLUMNS = ("revenue", "financial_health_score", "trading_volume", "trading_money", "transaction_count")
MISSING_TEXT = "N/A"


def percent_text(value: Column) -> Column:
    """Two decimals and no thousands separator: 0.1234 -> '12.34%'."""
    digits = F.translate(F.format_number(value * 100, 2), ",", "")
    return F.coalesce(F.concat(digits, F.lit("%")), F.lit(MISSING_TEXT))


def whole_text(value: Column) -> Column:
    return F.coalesce(F.format_number(value.cast("double"), 0), F.lit(MISSING_TEXT))


def price_text(value: Column) -> Column:
    return F.coalesce(F.format_number(value.cast("double"), 2), F.lit(MISSING_TEXT))


def report_table(df: DataFrame) -> DataFrame:
    """Every known report column as text; other columns unchanged."""

    def shown(name: str) -> Column:
        value = F.col(name)
        if name == "industry_group":
            return industry_label(value).alias(name)
        if name in PERCENT_COLUMNS:
            return percent_text(value).alias(name)
        if name in PRICE_COLUMNS:
            return price_text(value).alias(name)
        if name in WHOLE_COLUMNS:
            return whole_text(value).alias(name)
        return value

    return df.select(*[shown(name) for name in df.columns])
