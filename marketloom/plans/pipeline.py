"""The batch run: raw files -> silver tables -> gold tables -> catalog.

Each table is written once and read back, so a later table starts from stored data and not from
the whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators.headers import stack
from marketloom.plans import gold, silver
from marketloom.sources import readers, writers

# Raw dataset names, in order of precedence where there are several.
COMPANY_DATASET = "TWSECompanyInfo"
PRICE_DATASETS = (("TWSEStockDayAll", False), ("TWSEStockDayHistory", True), ("TaiwanStockPrice", True))
REVENUE_DATASETS = (("TWSEMonthlyRevenue", False), ("TaiwanStockMonthRevenue", True))
STATEMENT_DATASETS = {
    "income_statement": "TWSEIncomeStatement",
    "balance_sheet": "TWSEBalanceSheet",
    "cash_flow_statement": "TWSECashFlowStatement",
}
RATIO_DATASET = "TaiwanStockPER"
DIVIDEND_DATASET = "TaiwanStockDividend"

TABLES = {**schemas.SILVER_TABLES, **schemas.GOLD_TABLES}
PARTITIONED = {
    "gold_company_monthly_snapshot": "month",
    "gold_operating_dashboard": "month",
    "gold_revenue_growth": "month",
    "gold_semiconductor_peer_comparison": "month",
}
SORTED = {
    "silver_stock_price": ("stock_id", "date"),
    "silver_fundamental_metrics": ("stock_id", "date"),
    "silver_per_dividend": ("stock_id", "date"),
    "gold_company_monthly_snapshot": ("stock_id",),
    "gold_revenue_growth": ("stock_id",),
    "gold_operating_dashboard": ("stock_id",),
    "gold_semiconductor_peer_comparison": ("health_score_rank", "stock_id"),
}


class Lake:
    """Folders of one installation: ``raw``, ``silver`` and ``gold`` under a base path.

    With ``buckets``, silver tables are stored in so many files by stock, and the joins that make gold tables of them need no
    exchange; choose it so that a bucket of the daily prices suits a task.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.raw, self.silver, self.gold = (f"{base}/{layer}" for layer in ("raw", "silver", "gold"))

    def folder(self, name: str) -> str:
        return self.silver if name in schemas.SILVER_TABLES else self.gold

    def statements(self, dataset: str) -> DataFrame:
        """A statement of all its templates, one file or folder each, in ``{dataset}.csv`` or ``{dataset}_{template}.csv``; rows know
        their file as ``source_url``, unless a column of that name came with them."""
        files = readers.read_raw_files(self.spark, f"{self.raw}/{dataset}{{,_*}}.csv", lineage="_source")
        if "_source" not in files.columns:
            return files
        if "source_url" in files.columns:
            return files.withColumn("source_url", F.coalesce("source_url", "_source")).drop("_source")
        return files.withColumnRenamed("_source", "source_url")

    def feed(self, dataset: str, per_stock: bool = False) -> DataFrame:
        """A raw dataset: one file or folder, or one file per stock, or one folder per stock as
        ``write_raw(by_stock=True)`` lays them out; files and folders of one dataset are united."""
        whole = f"{self.raw}/{dataset}.csv"
        if not per_stock:
            return readers.read_raw(self.spark, whole)
        files = readers.read_raw_files(self.spark, f"{self.raw}/{dataset}_*.csv")
        if not readers.path_exists(self.spark, whole):
            return files
        return stack([files, readers.read_raw(self.spark, whole)])

    def table(self, name: str) -> DataFrame:
        if self.buckets and name in schemas.SILVER_TABLES:
            return readers.read_bucketed(
                self.spark, name, self.silver, TABLES[name], self.buckets, sort=SORTED.get(name, ())
            )
        return readers.read_table(self.spark, self.folder(name), name, TABLES[name])

    def store(self, df: DataFrame, name: str) -> DataFrame:
        if self.buckets and name in schemas.SILVER_TABLES:
            return writers.write_bucketed(df, name, self.silver, self.buckets, sort=SORTED.get(name, ()))
        writers.write_table(
            df, name, self.folder(name), partition=PARTITIONED.get(name), sort=SORTED.get(name, ())
        )
        return self.table(name)


def build_silver(
    lake: Lake,
    securities: DataFrame | None = None,
    start: str = silver.DEFAULT_START_DATE,
    end: str | None = None,
) -> None:
    configured = securities if securities is not None else readers.securities(lake.spark)
    lake.store(silver.company_table(lake.feed(COMPANY_DATASET), configured), "silver_company")

    prices = silver.clean_prices([lake.feed(name, per_stock) for name, per_stock in PRICE_DATASETS])
    lake.store(silver.price_table(prices, start, end), "silver_stock_price")

    revenue = silver.clean_revenue([lake.feed(name, per_stock) for name, per_stock in REVENUE_DATASETS])
    lake.store(silver.revenue_table(revenue, start[:7]), "silver_monthly_revenue")

    rows = {
        category: silver.statement_rows(lake.statements(dataset), category)
        for category, dataset in STATEMENT_DATASETS.items()
    }
    for category, statement in rows.items():
        lake.store(silver.statement_table(statement), f"silver_{category}")
    stored = [lake.table(f"silver_{category}") for category in rows]
    lake.store(silver.stack(stored), "silver_financial_statement")
    # Ratios are taken from the feed rows, which still know their landing order.
    lake.store(silver.fundamentals_table(list(rows.values())), "silver_fundamental_metrics")

    valuation = silver.clean_valuation(lake.feed(RATIO_DATASET, True), lake.feed(DIVIDEND_DATASET, True))
    lake.store(silver.valuation_table(valuation), "silver_per_dividend")


def build_gold(lake: Lake, focus_id: str = gold.FOCUS_ID) -> None:
    company, prices = lake.table("silver_company"), lake.table("silver_stock_price")
    fundamentals = lake.table("silver_fundamental_metrics")
    revenue = lake.table("silver_monthly_revenue")
    lake.store(gold.revenue_growth(gold.named_revenue(revenue, company)), "gold_revenue_growth")
    scored = gold.scored_months(revenue, company, prices, lake.table("silver_per_dividend"), fundamentals)
    snapshot = lake.store(gold.company_snapshot(scored), "gold_company_monthly_snapshot")
    lake.store(gold.price_features(prices, company), "gold_stock_price_features")
    lake.store(gold.operating_dashboard(snapshot, prices, fundamentals), "gold_operating_dashboard")
    peers = lake.store(gold.peer_comparison(snapshot), "gold_semiconductor_peer_comparison")
    lake.store(gold.focus_snapshot(snapshot, peers, focus_id), "gold_focus_snapshot")


def publish(lake: Lake, views: bool = False) -> list[str]:
    """Registers all stored tables in the session's catalog."""
    return [
        name
        for folder, tables in ((lake.silver, schemas.SILVER_TABLES), (lake.gold, schemas.GOLD_TABLES))
        for name in writers.publish_tables(lake.spark, tables, folder, views=views)
    ]


def run_all(lake: Lake, securities: DataFrame | None = None, end: str | None = None) -> list[str]:
    build_silver(lake, securities, end=end)
    build_gold(lake)
    return publish(lake, views=True)
