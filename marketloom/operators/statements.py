"""Statement line items: wide to long, long to wide, and the ratios on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.rules import account_metric, ratio
from marketloom.operators.headers import FEED_ORDER, LANDING_ORDER, quoted

# Columns that identify a statement row; all others of a wide feed are accounts.
STATEMENT_IDS = ("date", "year", "quarter", "stock_id", "stock_name", "statement_category", "source_url")
# Bit above the feed order for the preference between the names of one item.
PREFERENCE_BIT = 59

# The names under which each input of a ratio may appear, in order of preference.
RATIO_INPUTS = {
    "revenue": ("operating_revenue", "revenue", "營業收入", "收益"),
    "gross_profit": ("gross_profit", "營業毛利（毛損）", "營業毛利"),
    "operating_income": ("operating_income", "營業利益", "營業利益（損失）"),
    "net_income": ("net_income", "本期淨利（淨損）", "本期淨利"),
    "total_assets": ("total_assets", "資產總額"),
    "total_equity": ("total_equity", "權益總額", "權益總計"),
    "total_liabilities": ("total_liabilities", "負債總額"),
    "current_assets": ("current_assets", "流動資產"),
    "current_liabilities": ("current_liabilities", "流動負債"),
    "eps": ("earnings_per_share", "EPS", "基本每股盈餘（元）", "基本每股盈餘"),
}


def unpivot_accounts(wide: DataFrame) -> DataFrame:
    """One row per account column of a wide statement, as (type, value) text; without any, the input."""
    ids = [name for name in wide.columns if name in STATEMENT_IDS or name == LANDING_ORDER]
    accounts = [name for name in wide.columns if name not in ids]
    if not accounts:
        return wide
    text = wide.select(*ids, *[F.col(f"`{name}`").cast("string").alias(name) for name in accounts])
    return text.unpivot(ids, [f"`{name}`" for name in accounts], "type", "value")


def pivot_metrics(long: DataFrame, items: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (stock_id, date) with one column per item.

    An item takes the last known value of the first of its metric names that has one. The names are
    fixed, so one aggregate does it and no job has to discover the columns.
    """
    known = long.dropna(subset=["stock_id", "date", "value"])
    metric, place = F.col("normalized_metric_name"), F.col(FEED_ORDER)
    one_number = dict(long.dtypes)[FEED_ORDER] == "bigint"

    def last(item: str) -> Column:
        rank = F.lit(None)
        for preference, name in enumerate(reversed(items[item])):
            preferred = F.lit(preference << PREFERENCE_BIT) + place if one_number else F.struct(F.lit(preference), place)
            rank = F.when(metric == name, preferred).otherwise(rank)
        return F.max_by("value", rank).alias(item)

    return known.groupBy("stock_id", "date").agg(*[last(item) for item in items])


def account_metrics(wide: DataFrame, items: Mapping[str, Sequence[str]]) -> DataFrame:
    """What ``pivot_metrics`` gives for the accounts of typed statements with one row per (stock_id, date), without unpivoting them."""
    accounts = [name for name in wide.columns if name not in STATEMENT_IDS]
    held = {account_metric(name): quoted(name) for name in accounts}
    if len(held) < len(accounts):
        raise ValueError("accounts of one metric need landing orders, which only long rows have")

    def known(item: str) -> Column:
        return F.coalesce(*[held[name] for name in items[item] if name in held], F.lit(None).cast("double")).alias(item)

    rows = wide.dropna(subset=["stock_id", "date"]).where(F.coalesce(*held.values()).isNotNull())
    return rows.select("stock_id", "date", *[known(item) for item in items])


def fundamental_ratios(long: DataFrame) -> DataFrame:
    """ROE, ROA, margins, debt and current ratio, EPS per (stock_id, date)."""
    return item_ratios(pivot_metrics(long, RATIO_INPUTS))


def item_ratios(items: DataFrame) -> DataFrame:
    """The ratios on one row of items per (stock_id, date)."""

    def over(numerator: str, denominator: str) -> Column:
        return ratio(F.col(numerator), F.col(denominator))

    return items.select(
        "date",
        "stock_id",
        over("net_income", "total_equity").alias("roe"),
        over("net_income", "total_assets").alias("roa"),
        over("gross_profit", "revenue").alias("gross_margin"),
        over("operating_income", "revenue").alias("operating_margin"),
        over("total_liabilities", "total_assets").alias("debt_ratio"),
        over("current_assets", "current_liabilities").alias("current_ratio"),
        "eps",
    )
