"""Silver tables: cleaned, unified and enriched feeds. All inputs are text-only frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.functions import dates, rules, text
from marketloom.operators.headers import (
    FEED_ORDER,
    LANDING_ORDER,
    conform,
    quoted,
    stack,
    stack_sources,
    unify_headers,
)
from marketloom.operators.latest import keep_last, last_non_null
from marketloom.operators.series import add_price_features, add_revenue_growth
from marketloom.operators.statements import RATIO_INPUTS, account_metrics, fundamental_ratios, item_ratios, unpivot_accounts

# ---------------------------------------------------------------------------
# Feed headers per canonical column, defaults.
# ---------------------------------------------------------------------------
DEFAULT_START_DATE = "2021-05-01"
EXCLUDED_IDS = ("0050",)

PRICE_HEADERS = {
    "stock_id": ("stock_id", "Code", "證券代號"),
    "date": ("date", "日期", "snapshot_date"),
    "open_price": ("open", "OpeningPrice", "開盤價"),
    "high_price": ("max", "HighestPrice", "最高價"),
    "low_price": ("min", "LowestPrice", "最低價"),
    "close_price": ("close", "ClosingPrice", "收盤價"),
    "price_change": ("Change", "漲跌價差", "spread"),
    "trading_volume": ("Trading_Volume", "TradeVolume", "成交股數"),
    "trading_money": ("Trading_money", "TradeValue", "成交金額"),
    "transaction_count": ("Transaction", "成交筆數", "Trading_turnover"),
}

REVENUE_HEADERS = {
    "stock_id": ("stock_id", "公司代號"),
    "stock_name": ("stock_name", "公司名稱"),
    "revenue": ("revenue", "營業收入-當月營收", "當月營收"),
    "mom_percent": ("revenue_mom_percent", "上月比較增減(%)", "營業收入-上月比較增減(%)"),
    "yoy_percent": ("revenue_yoy_percent", "去年同月增減(%)", "營業收入-去年同月增減(%)"),
    "date": ("date",),
    "revenue_year": ("revenue_year",),
    "revenue_month": ("revenue_month",),
    "feed_month": ("資料年月",),
}
REPORTED_BIT = 61  # above every feed order
FEED_REVENUE_UNIT = 1000  # feeds with a 資料年月 column report in thousands

COMPANY_HEADERS = {
    "stock_id": ("stock_id", "公司代號"),
    "stock_name": ("stock_name", "公司名稱"),
    "industry_group": ("industry_group", "產業別"),
    "market_type": ("market_type", "上市別"),
}

STATEMENT_HEADERS = {
    "date": ("date", "出表日期"),
    "year": ("year", "年度"),
    "quarter": ("quarter", "季別"),
    "stock_id": ("stock_id", "公司代號"),
    "stock_name": ("stock_name", "公司名稱"),
    "type": ("type", "會計項目"),
    "value": ("value", "金額", "本期金額", "本期"),
}
STATEMENT_CATEGORIES = ("income_statement", "balance_sheet", "cash_flow_statement")

VALUATION_HEADERS = {
    "date": ("date",),
    "stock_id": ("stock_id",),
    "pe_ratio": ("pe_ratio", "PER"),
    "dividend_yield": ("dividend_yield",),
    "price_book_ratio": ("price_book_ratio", "PBR"),
}
DIVIDEND_HEADERS = {
    "date": ("date",),
    "stock_id": ("stock_id",),
    "pe_ratio": ("pe_ratio",),
    "dividend_yield": ("dividend_yield",),
    "price_book_ratio": ("price_book_ratio",),
}
CASH_DIVIDEND = "CashEarningsDistribution"
# ---------------------------------------------------------------------------

NUMERIC_PRICES = tuple(name for name in PRICE_HEADERS if name not in ("stock_id", "date"))


# --- company -----------------------------------------------------------------


def company_table(feed: DataFrame, configured: DataFrame) -> DataFrame:
    """One row per company: the feed's last record, the configured focus flag, and configured
    companies that the feed lacks."""
    listed = stack_sources([unify_headers(feed, COMPANY_HEADERS, keep=[LANDING_ORDER])])
    listed = listed.withColumn("stock_id", text.normalize_id(F.col("stock_id"))).dropna(subset=["stock_id"])
    listed = keep_last(listed, ["stock_id"])

    own = configured.dropna(subset=["stock_id"])
    if "place" in own.columns:  # the first entry of an id counts
        own = keep_last(own, ["stock_id"], [-F.col("place")])
    own = conform(own, schemas.SILVER_COMPANY)
    flagged = listed.join(own.select("stock_id", "focus_flag"), "stock_id", "left").withColumn(
        "focus_flag", F.coalesce(F.col("focus_flag"), F.lit(False))
    )
    absent = own.join(listed.select("stock_id"), "stock_id", "left_anti")
    return stack([conform(flagged, schemas.SILVER_COMPANY), conform(absent, schemas.SILVER_COMPANY)])


def _by_stock(rows: DataFrame, wanted: bool) -> DataFrame:
    """The rows, if wanted dealt by stock before anything is folded: the folds, windows and joins by stock after it then need no exchange of
    their own. That is for feeds with few rows per stock and day (or month); feeds that repeat them are better folded first."""
    return rows.repartition("stock_id") if wanted else rows


def _last_wanted(rows: DataFrame, keys: Sequence[str], wanted: Column | None = None, order: Sequence = (FEED_ORDER,)) -> DataFrame:
    """The last row of each key without nulls for which ``wanted``, a condition on the keys, holds; without its place, which for rows
    of files is long.

    The condition is aggregated along with the row and applied last. A filter in front would be pushed below the parsing of the
    keys, so that their texts are parsed twice.
    """
    known = reduce(Column.__and__, [F.col(name).isNotNull() for name in keys])
    marked = rows.withColumn("_wanted", known if wanted is None else known & wanted)
    return keep_last(marked, keys, order, without=[FEED_ORDER]).where("_wanted").drop("_wanted")


# --- prices ------------------------------------------------------------------


def clean_prices(feeds: Sequence[DataFrame], excluded: Sequence[str] = EXCLUDED_IDS, by_stock: bool = False) -> DataFrame:
    """Typed daily prices, one row per (stock_id, date); later feeds and later rows win. ``by_stock`` deals the rows as ``_by_stock`` says."""
    unified = [unify_headers(feed, PRICE_HEADERS, keep=[LANDING_ORDER]) for feed in feeds]
    # Two steps, so that each text is stripped once although the number rule reads it twice.
    stripped = stack_sources(unified).select(
        dates.trade_date(F.col("date")).alias("date"),
        text.normalize_id(F.col("stock_id")).alias("stock_id"),
        *[text.price_text(F.col(name)).alias(name) for name in NUMERIC_PRICES],
        FEED_ORDER,
    )
    typed = _by_stock(stripped.withColumns({name: text.number(F.col(name)) for name in NUMERIC_PRICES}), by_stock)
    wanted = ~F.col("stock_id").isin(*excluded) if excluded else None
    return conform(_last_wanted(typed, ["stock_id", "date"], wanted), schemas.PRICE_INPUT)


def price_table(prices: DataFrame, start: str | None = DEFAULT_START_DATE, end: str | None = None) -> DataFrame:
    """Daily prices with their features. The date bounds apply after the features, so that the
    first kept day still has its history and the last month its month end."""
    featured = add_price_features(prices)
    if start:
        featured = featured.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        featured = featured.where(F.col("date") <= F.lit(end).cast("date"))
    return conform(featured, schemas.SILVER_STOCK_PRICE)


# --- revenue -----------------------------------------------------------------


def clean_revenue(feeds: Sequence[DataFrame], by_stock: bool = False) -> DataFrame:
    """Typed monthly revenue, one row per (stock_id, month); rows with reported growth win. ``by_stock`` deals the rows as ``_by_stock`` says."""
    unified = [unify_headers(feed, REVENUE_HEADERS, keep=[LANDING_ORDER]) for feed in feeds]
    amount = text.plain_number(F.col("revenue"))
    month = F.coalesce(
        dates.month_of(dates.plain_date(F.col("date"))),
        dates.year_month(F.col("revenue_year"), F.col("revenue_month")),
        dates.feed_month(F.col("feed_month")),
    )
    typed = stack_sources(unified).select(
        month.alias("month"),
        text.normalize_id(F.col("stock_id")).alias("stock_id"),
        F.when(F.col("feed_month").isNotNull(), amount * FEED_REVENUE_UNIT).otherwise(amount).alias("revenue"),
        (text.strict_number(F.col("mom_percent")) / 100).alias("reported_mom"),
        (text.strict_number(F.col("yoy_percent")) / 100).alias("reported_yoy"),
        FEED_ORDER,
    )
    reported = F.col("reported_mom").isNotNull() | F.col("reported_yoy").isNotNull()
    if dict(typed.dtypes)[FEED_ORDER] == "bigint":  # one number, for hash aggregation
        order = [F.col(FEED_ORDER) + F.when(reported, F.lit(1 << REPORTED_BIT)).otherwise(0)]
    else:
        order = [reported.alias("reported"), FEED_ORDER]
    return _last_wanted(_by_stock(typed, by_stock), ["stock_id", "month"], order=order)


def revenue_table(
    revenue: DataFrame, start_month: str | None = DEFAULT_START_DATE[:7], fill: str = "pad"
) -> DataFrame:
    """Monthly revenue with growth and signal. Reported growth replaces the computed one."""
    return conform(grown_revenue(revenue, start_month, fill), schemas.SILVER_MONTHLY_REVENUE)


def grown_revenue(revenue: DataFrame, start_month: str | None, fill: str = "pad") -> DataFrame:
    """The rows of ``revenue_table`` with whatever other columns they have."""
    grown = add_revenue_growth(revenue, fill)
    for name in ("mom", "yoy"):
        if f"reported_{name}" in revenue.columns:
            grown = grown.withColumn(
                f"revenue_{name}", F.coalesce(F.col(f"reported_{name}"), F.col(f"revenue_{name}"))
            )
    signal = rules.growth_signal(F.col("revenue_mom"), F.col("revenue_yoy"))
    grown = grown.withColumn("revenue_growth_signal", signal)
    if start_month:
        grown = grown.where(F.col("month") >= start_month)
    return grown


# --- statements --------------------------------------------------------------


def statement_rows(feed: DataFrame, category: str) -> DataFrame:
    """Long statement rows of one category, with their landing order."""
    tagged = feed.withColumn("statement_category", F.lit(category))
    renames = {
        header: name
        for name, headers in STATEMENT_HEADERS.items()
        for header in headers
        if header in tagged.columns and header != name and name not in ("value",)
    }
    rows = tagged.withColumnsRenamed(renames)
    amounts = [header for header in STATEMENT_HEADERS["value"] if header in rows.columns]
    if amounts:
        merged = F.coalesce(*[quoted(header) for header in amounts])
        rows = rows.withColumn("_amount", merged).drop(*amounts).withColumnRenamed("_amount", "value")
    if not {"type", "value"} <= set(rows.columns):
        rows = unpivot_accounts(rows)
    if "date" not in rows.columns and {"year", "quarter"} <= set(rows.columns):
        rows = rows.withColumn("date", F.concat(F.col("year"), F.lit("Q"), F.col("quarter")))
    for name in ("date", "stock_id", "type", "value"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    order = F.col(LANDING_ORDER) if LANDING_ORDER in rows.columns else F.lit(0).cast("bigint")
    return rows.select(
        dates.statement_date(F.col("date")).alias("date"),
        F.coalesce(text.normalize_id(F.col("stock_id")), F.lit("")).alias("stock_id"),
        "statement_category",
        "type",
        text.plain_number(F.col("value")).alias("value"),
        rules.metric_name(F.col("type")).alias("normalized_metric_name"),
        order.alias(LANDING_ORDER),
    )


def statement_table(rows: DataFrame) -> DataFrame:
    return conform(rows, schemas.SILVER_STATEMENT)


def fundamentals_table(statements: Sequence[DataFrame]) -> DataFrame:
    """Ratios per (stock_id, date) over the income, balance and cash flow rows, in this precedence;
    the last known value of an item counts."""
    return conform(fundamental_ratios(stack_sources(statements)), schemas.SILVER_FUNDAMENTALS)


def fundamentals_of_accounts(wide: DataFrame) -> DataFrame:
    """The same ratios from typed statements with one row per (stock_id, date) and one column per account."""
    return conform(item_ratios(account_metrics(wide, RATIO_INPUTS)), schemas.SILVER_FUNDAMENTALS)


# --- valuation ---------------------------------------------------------------


VALUATION_VALUES = ("pe_ratio", "dividend_yield", "price_book_ratio")


def clean_valuation(ratios: DataFrame | None, dividends: DataFrame | None, by_stock: bool = False) -> DataFrame:
    """Typed ratio and dividend rows; dividend rows come after ratio rows. ``by_stock`` deals them as ``_by_stock`` says."""
    feeds = []
    if ratios is not None:
        feeds.append(unify_headers(ratios, VALUATION_HEADERS, keep=[LANDING_ORDER]))
    if dividends is not None:
        if CASH_DIVIDEND in dividends.columns:  # the cash per share is stored under the yield's name
            dividends = dividends.withColumn("dividend_yield", F.col(CASH_DIVIDEND))
        feeds.append(unify_headers(dividends, DIVIDEND_HEADERS, keep=[LANDING_ORDER]))
    if not feeds:
        raise ValueError("at least one valuation feed is needed")
    typed = stack_sources(feeds).select(
        dates.plain_date(F.col("date")).alias("date"),
        text.normalize_id(F.col("stock_id")).alias("stock_id"),
        *[text.strict_number(F.col(name)).alias(name) for name in VALUATION_VALUES],
        FEED_ORDER,
    )
    return _by_stock(typed.dropna(subset=["date", "stock_id"]), by_stock)


def valuation_table(valuation: DataFrame) -> DataFrame:
    """PE, yield and price/book per (stock_id, date), each the last known of its typed rows."""
    last = last_non_null(valuation, ["stock_id", "date"], VALUATION_VALUES, [FEED_ORDER])
    return conform(last, schemas.SILVER_VALUATION)
