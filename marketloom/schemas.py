"""Column layout of every silver and gold table."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "date": T.DateType(),
}


def _table(columns: str) -> T.StructType:
    """A schema from 'name type, name type'."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Names, types and order of the table columns.
SILVER_COMPANY = _table(
    "stock_id string, stock_name string, industry_group string, market_type string, focus_flag boolean"
)

PRICE_INPUT = _table(
    "date date, stock_id string, open_price double, high_price double, low_price double, close_price double, "
    "price_change double, trading_volume double, trading_money double, transaction_count double"
)

SILVER_STOCK_PRICE = _table(
    "date date, stock_id string, open_price double, high_price double, low_price double, close_price double, "
    "price_change double, trading_volume double, trading_money double, transaction_count double, "
    "daily_return double, monthly_return double, ma_20 double, ma_60 double, volatility_20d double, "
    "price_above_ma20_flag boolean, price_above_ma60_flag boolean"
)

SILVER_MONTHLY_REVENUE = _table(
    "month string, stock_id string, revenue double, revenue_mom double, revenue_yoy double, "
    "revenue_growth_signal string"
)

SILVER_STATEMENT = _table(
    "date string, stock_id string, statement_category string, type string, value double, "
    "normalized_metric_name string"
)

SILVER_FUNDAMENTALS = _table(
    "date string, stock_id string, roe double, roa double, gross_margin double, operating_margin double, "
    "debt_ratio double, current_ratio double, eps double"
)

SILVER_VALUATION = _table(
    "date date, stock_id string, pe_ratio double, dividend_yield double, price_book_ratio double"
)

GOLD_SNAPSHOT = _table(
    "month string, stock_id string, stock_name string, industry_group string, market_type string, "
    "focus_flag boolean, close_price double, monthly_return double, revenue double, revenue_mom double, "
    "revenue_yoy double, pe_ratio double, dividend_yield double, roe double, roa double, gross_margin double, "
    "operating_margin double, debt_ratio double, current_ratio double, eps double, volatility_20d double, "
    "price_above_ma20_flag boolean, price_above_ma60_flag boolean, financial_health_score int, risk_level string"
)

GOLD_PRICE_FEATURES = _table(
    "date date, stock_id string, stock_name string, industry_group string, close_price double, open_price double, "
    "high_price double, low_price double, price_change double, trading_volume double, trading_money double, "
    "transaction_count double, daily_return double, monthly_return double, ma_20 double, ma_60 double, "
    "volatility_20d double, price_above_ma20_flag boolean, price_above_ma60_flag boolean"
)

GOLD_DASHBOARD = T.StructType(
    GOLD_SNAPSHOT.fields
    + _table(
    "latest_price_date date, open_price double, high_price double, low_price double, price_change double, "
    "trading_volume double, trading_money double, transaction_count double, daily_return double, ma_20 double, "
    "ma_60 double, latest_fundamental_date string"
).fields
)

GOLD_REVENUE_GROWTH = _table(
    "month string, stock_id string, stock_name string, industry_group string, revenue double, revenue_mom double, "
    "revenue_yoy double, revenue_growth_signal string"
)

GOLD_PEERS = _table(
    "month string, stock_id string, stock_name string, revenue double, revenue_yoy double, monthly_return double, "
    "volatility_20d double, pe_ratio double, financial_health_score int, risk_level string, "
    "revenue_yoy_rank double, monthly_return_rank double, health_score_rank double, volatility_rank double"
)

GOLD_FOCUS = _table(
    "month string, stock_id string, stock_name string, close_price double, monthly_return double, revenue double, "
    "revenue_mom double, revenue_yoy double, pe_ratio double, dividend_yield double, volatility_20d double, "
    "financial_health_score int, risk_level string, semiconductor_revenue_yoy_rank double, "
    "semiconductor_health_score_rank double"
)

SILVER_TABLES = {
    "silver_company": SILVER_COMPANY,
    "silver_stock_price": SILVER_STOCK_PRICE,
    "silver_monthly_revenue": SILVER_MONTHLY_REVENUE,
    "silver_income_statement": SILVER_STATEMENT,
    "silver_balance_sheet": SILVER_STATEMENT,
    "silver_cash_flow_statement": SILVER_STATEMENT,
    "silver_financial_statement": SILVER_STATEMENT,
    "silver_fundamental_metrics": SILVER_FUNDAMENTALS,
    "silver_per_dividend": SILVER_VALUATION,
}

GOLD_TABLES = {
    "gold_company_monthly_snapshot": GOLD_SNAPSHOT,
    "gold_stock_price_features": GOLD_PRICE_FEATURES,
    "gold_operating_dashboard": GOLD_DASHBOARD,
    "gold_revenue_growth": GOLD_REVENUE_GROWTH,
    "gold_semiconductor_peer_comparison": GOLD_PEERS,
    "gold_focus_snapshot": GOLD_FOCUS,
}
