"""Queries behind the report pages. Each returns a DataFrame; filters are optional arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import dates, rules
from marketloom.operators.latest import (
    keep_last,
    last_non_null,
    latest_month_rows,
    latest_per_stock,
    month_end_rows,
)
from marketloom.operators.ranking import Rank, add_min_ranks, add_risk_bands, group_medians

# Report sizes and labels.
TOP_ROWS = 10
UNIVERSE_ROWS = 20
QUALIFYING_MONTHS = 12
ALL_INDUSTRIES = "All"
ALERT_LEVELS = ("High", "Watch")

INDUSTRY_RANKS = (
    Rank("revenue_yoy", "industry_revenue_yoy_rank"),
    Rank("monthly_return", "industry_monthly_return_rank"),
    Rank("financial_health_score", "industry_health_score_rank"),
    Rank("volatility_20d", "industry_volatility_rank", ascending=True),
)

# Report headers of the rank table.
RANK_TABLE_HEADERS = {
    "month": "月份",
    "industry_group": "產業",
    "industry_peer_count": "同業家數",
    "industry_revenue_yoy_rank": "營收 YoY 排名",
    "industry_monthly_return_rank": "月報酬排名",
    "industry_health_score_rank": "健康分數排名",
    "industry_volatility_rank": "波動率排名",
}

# Profile columns in report order.
PROFILE_COLUMNS = (
    "month", "latest_price_date", "latest_fundamental_date", "stock_id", "stock_name", "industry_group",
    "market_type", "open_price", "high_price", "low_price", "close_price", "price_change", "trading_volume",
    "trading_money", "transaction_count", "daily_return", "monthly_return", "volatility_20d", "revenue_yoy",
    "revenue_mom", "roe", "roa", "gross_margin", "operating_margin", "debt_ratio", "current_ratio", "eps",
    "risk_level", "financial_health_score",
)


# --- filters -----------------------------------------------------------------


def in_months(df: DataFrame, months: tuple[str, str] | None = None) -> DataFrame:
    """Inclusive month range; None keeps everything."""
    return df if months is None else df.where(F.col("month").between(*months))


def in_industry(df: DataFrame, industry: str = ALL_INDUSTRIES) -> DataFrame:
    return df if industry == ALL_INDUSTRIES else df.where(F.col("industry_group") == industry)


def of_stock(df: DataFrame, stock_id: str) -> DataFrame:
    return df.where(F.col("stock_id").cast("string") == stock_id)


def in_universe(df: DataFrame, universe: DataFrame | None) -> DataFrame:
    """Rows of the listed stocks; no universe, or one without stocks, keeps everything."""
    if universe is None:
        return df
    listed = universe.select("stock_id", F.lit(True).alias("_listed")).distinct()
    stocks = universe.agg(F.count("stock_id")).scalar()
    found = df.join(listed, "stock_id", "left").where(F.col("_listed").isNotNull() | (stocks == 0))
    return found.select(*df.columns)


def text_keys(df: DataFrame) -> DataFrame:
    """stock_id and month as text, whatever a CSV table made of them."""
    return df.withColumns({name: F.col(name).cast("string") for name in ("stock_id", "month") if name in df.columns})


def top_rows(df: DataFrame, column: str, rows: int = TOP_ROWS, ascending: bool = False) -> DataFrame:
    """Highest (or lowest) rows with nulls last in both directions; stock_id breaks ties."""
    value = F.col(column)
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return df.orderBy(order, F.col("stock_id").asc_nulls_last()).limit(rows)


# --- overview and risk pages --------------------------------------------------


def monitored_companies(
    snapshot: DataFrame, months: tuple[str, str] | None = None, industry: str = ALL_INDUSTRIES
) -> DataFrame:
    """Latest record of each stock in the selection, with the relative risk levels."""
    selected = in_industry(in_months(snapshot, months), industry)
    return add_risk_bands(latest_per_stock(selected), rules.risk_level)


def overview_kpis(monitored: DataFrame) -> DataFrame:
    """Mean score and the number of companies per risk level."""
    level = F.col("risk_level")
    return monitored.agg(
        F.avg("financial_health_score").alias("avg_health_score"),
        *[F.count_if(level == name).alias(f"{name.lower()}_companies") for name in reversed(rules.RISK_ORDER)],
    )


def alert_companies(monitored: DataFrame, levels: Sequence[str] = ALERT_LEVELS) -> DataFrame:
    order = [F.col("financial_health_score").asc_nulls_last(), F.col("stock_id").asc_nulls_last()]
    return monitored.where(F.col("risk_level").isin(*levels)).orderBy(*order)


def weak_trend(monitored: DataFrame) -> DataFrame:
    """Falling revenue and a price known to be below its 60-day average."""
    return monitored.where((F.col("revenue_yoy") < 0) & ~F.col("price_above_ma60_flag"))


def risk_counts(monitored: DataFrame) -> DataFrame:
    counts = monitored.groupBy("risk_level").agg(F.count(F.lit(1)).alias("company_count"))
    return counts.orderBy(rules.label_position(F.col("risk_level"), rules.RISK_ORDER))


def latest_price_date(price_features: DataFrame, dashboard: DataFrame) -> DataFrame:
    """The later of the last trading day and the dashboard's last price date, 'N/A' when neither is known."""
    days = price_features.agg(F.max("date").alias("day")).unionByName(
        dashboard.agg(F.max("latest_price_date").alias("day"))
    )
    return days.agg(F.coalesce(F.max("day").cast("string"), F.lit("N/A")).alias("latest_price_date"))


# --- growth page ---------------------------------------------------------------


def signal_summary(growth: DataFrame) -> DataFrame:
    """Per growth signal of the latest month: companies, growth averages, revenue and share."""
    signal = "revenue_growth_signal"
    latest = latest_month_rows(growth).select("stock_id", signal, "revenue", "revenue_yoy", "revenue_mom")
    summary = latest.groupBy(signal).agg(
        F.count_distinct("stock_id").alias("company_count"),
        F.avg("revenue_yoy").alias("avg_revenue_yoy"),
        F.avg("revenue_mom").alias("avg_revenue_mom"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"),
    )
    medians = group_medians(latest, signal, "revenue_yoy", "median_revenue_yoy").withColumnRenamed(signal, "_signal")
    joined = summary.join(medians, F.col(signal).eqNullSafe(F.col("_signal")), "left").drop("_signal")
    # One row per signal, so the total over all of them is a window over a handful of rows.
    total = F.sum("company_count").over(Window.partitionBy())
    label = F.coalesce(F.col(signal), F.lit("Unknown"))
    return (
        joined.withColumn("company_share", rules.ratio(F.col("company_count"), total))
        .withColumn(signal, label)
        .orderBy(rules.label_position(F.col(signal), rules.SIGNAL_ORDER))
    )


def companies_of_signal(growth: DataFrame, signal: str) -> DataFrame:
    label = F.coalesce(F.col("revenue_growth_signal"), F.lit("Unknown"))
    order = [F.col("revenue_yoy").desc_nulls_last(), F.col("stock_id").asc_nulls_last()]
    return latest_month_rows(growth).where(label == signal).orderBy(*order)


# --- company page ---------------------------------------------------------------


def industry_ranks(
    source: DataFrame,
    months: tuple[str, str] | None = None,
    stock_id: str | None = None,
) -> DataFrame:
    """Monthly ranks of each stock among the stocks of its last known industry.

    All stocks are ranked in one pass; ``stock_id`` selects one stock from the result.
    """
    columns = ["month", "stock_id", "stock_name", "industry_group", *[rank.value for rank in INDUSTRY_RANKS]]
    df = in_months(source, months).select(*columns)
    # A maximum of structs, which does not mind repeated rows, lets Spark leave out the joins below that only add columns.
    last = F.max(F.when(F.col("industry_group").isNotNull(), F.struct("month", "industry_group")))
    industry = df.groupBy("stock_id").agg(last["industry_group"].alias("industry_group"))
    if stock_id is not None:
        # Only the industry of this stock takes part, so prune before ranking.
        industry = of_stock(industry, stock_id)
        df = df.where(F.col("industry_group") == industry.select("industry_group").scalar())
    counts = df.groupBy("industry_group", "month").agg(F.count_distinct("stock_id").alias("industry_peer_count"))
    ranked = add_min_ranks(df.where(F.col("industry_group").isNotNull()), ["industry_group", "month"], INDUSTRY_RANKS)
    return (
        ranked.join(industry, ["stock_id", "industry_group"], "left_semi")
        .join(counts, ["industry_group", "month"], "left")
        .select(
            "month", "stock_id", "stock_name", "industry_group", "industry_peer_count",
            *[rank.name for rank in INDUSTRY_RANKS],
        )
    )


def company_profile(
    source: DataFrame, ranks: DataFrame, stock_id: str, months: tuple[str, str] | None = None
) -> DataFrame:
    """The stock's latest profile row with its industry ranks of that month."""
    rows = in_months(of_stock(source, stock_id), months)
    profile = latest_per_stock(rows).select(*[name for name in PROFILE_COLUMNS if name in source.columns])
    own = of_stock(ranks, stock_id).drop("stock_id", "stock_name", "industry_group")
    return profile.join(own, "month", "left")


def last_known_names(source: DataFrame) -> DataFrame:
    """Last known name and industry of every stock, each on its own."""
    names = last_non_null(source, ["stock_id"], ["stock_name", "industry_group"], ["month"])
    return names.withColumn("stock_name", F.coalesce(F.col("stock_name"), F.col("stock_id")))


def rank_table(ranks: DataFrame) -> DataFrame:
    """Rank columns under their report headers, latest month first, ranks as nullable integers."""
    whole = [name for name in RANK_TABLE_HEADERS if name not in ("month", "industry_group")]
    shown = ranks.select(*RANK_TABLE_HEADERS).withColumns({name: F.col(name).cast("long") for name in whole})
    return shown.orderBy(F.col("month").desc_nulls_last()).withColumnsRenamed(RANK_TABLE_HEADERS)


def rank_trend(ranks: DataFrame) -> DataFrame:
    """One row per month and rank type."""
    ids = [name for name in ("stock_id", "month") if name in ranks.columns]
    names = [rank.name for rank in INDUSTRY_RANKS]
    return ranks.select(*ids, *names).unpivot(ids, names, "rank_type", "rank")


def monthly_prices(price_features: DataFrame) -> DataFrame:
    return month_end_rows(price_features)


def price_revenue_relation(company: DataFrame) -> DataFrame:
    return company.select("month", "close_price", "revenue_yoy", "revenue_mom").dropna(subset=["close_price"])


def trend_series(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Points of a line: dates become months, incomplete points drop, ordered by x."""
    if x == "date":
        day = F.col("date") if dict(df.dtypes)["date"] == "date" else dates.plain_date(F.col("date"))
        df, x = df.withColumn("month", dates.month_of(day)), "month"
    columns = [x, y, *([color] if color else [])]
    return df.select(*columns).dropna(subset=[x, y]).orderBy(x)


def latest_statement(statements: DataFrame, stock_id: str) -> DataFrame:
    """Line items of the stock's latest statement date."""
    rows = of_stock(statements, stock_id).withColumn("date", dates.plain_date(F.col("date")))
    latest = rows.where(F.col("date") == rows.select(F.max("date")).scalar())
    return latest.select("date", "type", "normalized_metric_name", "value").orderBy("type")


def statement_trend(statements: DataFrame, stock_id: str, metrics: Sequence[str]) -> DataFrame:
    rows = of_stock(statements, stock_id).where(F.col("normalized_metric_name").isin(*metrics))
    return trend_series(rows, "date", "value", "normalized_metric_name")


# --- peer page -----------------------------------------------------------------


def latest_peers(peers: DataFrame, months: tuple[str, str] | None = None) -> DataFrame:
    """Peers of the last month in range; of the last month at all when the range is empty."""
    month = F.col("month")
    in_range = F.lit(True) if months is None else month.between(*months)
    chosen = peers.agg(F.coalesce(F.max(F.when(in_range, month)), F.max(month))).scalar()
    order = [F.col("health_score_rank").asc_nulls_last(), F.col("stock_id")]
    return peers.where(month == chosen).orderBy(*order)


# --- universe -------------------------------------------------------------------


def traded_universe(dashboard: DataFrame, required: Sequence[str] = (), rows: int = UNIVERSE_ROWS) -> DataFrame:
    """The most traded stocks by their latest record's trading money, plus required ids."""
    money = F.coalesce(F.col("trading_money"), F.lit(0.0))
    stocks = dashboard.select("stock_id", "latest_price_date", money.alias("trading_money"))
    latest = keep_last(stocks, ["stock_id"], ["latest_price_date", "trading_money"])
    universe = top_rows(latest, "trading_money", rows).select("stock_id")
    if required:
        listed = dashboard.sparkSession.createDataFrame([(item,) for item in required], "stock_id string")
        universe = universe.union(listed).distinct()
    return universe


def month_counts(df: DataFrame, name: str) -> DataFrame:
    month = F.col("month") if "month" in df.columns else dates.month_of(F.col("date"))
    return df.groupBy("stock_id").agg(F.count_distinct(month).alias(name))


def qualified_universe(
    universe: DataFrame,
    snapshot: DataFrame,
    price_features: DataFrame,
    growth: DataFrame,
    min_months: int = QUALIFYING_MONTHS,
) -> DataFrame:
    """Universe stocks with enough distinct months in all three tables.

    The universe filters each table first, so only its stocks are counted.
    """
    tables = {"snapshot_months": snapshot, "price_months": price_features, "growth_months": growth}
    result = universe.select("stock_id")
    for name, table in tables.items():
        enough = month_counts(in_universe(table, universe), name).where(F.col(name) >= min_months)
        result = result.join(enough, "stock_id")
    return result


def app_universe(
    configured: DataFrame,
    dashboard: DataFrame,
    snapshot: DataFrame,
    price_features: DataFrame,
    growth: DataFrame,
    required: Sequence[str] = (),
) -> DataFrame:
    """The stocks that the report pages show: the configured ones, or, if none is configured, the most traded and the required
    ones that have enough months. The choice is a scalar subquery, so no job runs while the query is built."""
    listed = configured.where(F.col("stock_id").isNotNull()).select("stock_id").distinct()
    count = configured.agg(F.count("stock_id")).scalar()
    traded = qualified_universe(traded_universe(dashboard, required), snapshot, price_features, growth)
    return listed.union(traded.select("stock_id").where(count == 0))


def value_lists(dashboard: DataFrame, price_features: DataFrame, growth: DataFrame) -> DataFrame:
    """Distinct months, stock ids and industries to choose from, industries by their label. Each table is read once and
    gives its values as (kind, value) pairs, which fold inside the tasks."""

    def values(df: DataFrame, month: Column, *kinds: str) -> DataFrame:
        columns = {"month": month} | {kind: F.col(kind) for kind in kinds}
        pairs = [F.struct(F.lit(kind).alias("kind"), column.alias("value")) for kind, column in columns.items()]
        return df.select(F.inline(F.array(*pairs)))

    month = F.col("month")
    found = (
        values(dashboard, month, "stock_id", "industry_group")
        .union(values(price_features, dates.month_of(F.col("date")), "stock_id", "industry_group"))
        .union(values(growth, month))
    )
    label = F.when(F.col("kind") == "industry_group", rules.industry_label(F.col("value"))).otherwise(F.col("value"))
    return found.dropna().distinct().withColumn("label", label).orderBy("kind", "label", "value")


def default_start_month(months: DataFrame, today: Column) -> DataFrame:
    """First present month not before five years ago, else the first month of all."""
    start = dates.five_years_before(today)
    month = F.col("month")
    return months.agg(F.coalesce(F.min(F.when(month >= start, month)), F.min(month)).alias("default_start_month"))

