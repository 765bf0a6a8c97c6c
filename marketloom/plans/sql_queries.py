"""The SQL query surface: SELECT statements over gold tables, run by ``spark.sql``.

Tables are passed in as DataFrames, so the same text runs over saved tables or lazy plans. Every
ascending key says NULLS LAST, as Spark would put nulls first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

FOCUS_MONTHS = 24
# The labels of the saved query. No job emits 'High Risk'; the DataFrame form of the
# query takes ('High', 'Watch').
HIGH_RISK_LABELS = ("High Risk", "Watch")

HIGH_RISK = """
SELECT month, stock_id, stock_name, industry_group, revenue_yoy, monthly_return, volatility_20d,
       financial_health_score, risk_level
FROM {snapshot}
WHERE month = (SELECT max(month) FROM {snapshot}) AND array_contains(:labels, risk_level)
ORDER BY financial_health_score ASC NULLS LAST, volatility_20d DESC NULLS LAST, stock_id ASC NULLS LAST
"""

LATEST_PEERS = """
SELECT month, stock_id, stock_name, revenue_yoy, monthly_return, volatility_20d, pe_ratio,
       financial_health_score, risk_level, revenue_yoy_rank, monthly_return_rank, health_score_rank,
       volatility_rank
FROM {peers}
WHERE month = (SELECT max(month) FROM {peers})
ORDER BY health_score_rank ASC NULLS LAST, revenue_yoy_rank ASC NULLS LAST, stock_id ASC NULLS LAST
"""

TOP_GROWTH = """
SELECT month, stock_id, stock_name, industry_group, revenue, revenue_yoy, revenue_mom, revenue_growth_signal
FROM {growth}
WHERE month = (SELECT max(month) FROM {growth})
ORDER BY revenue_yoy DESC NULLS LAST, stock_id ASC NULLS LAST
LIMIT 10
"""

FOCUS_HISTORY = """
SELECT month, stock_id, stock_name, close_price, monthly_return, revenue, revenue_mom, revenue_yoy, pe_ratio,
       dividend_yield, volatility_20d, financial_health_score, risk_level, semiconductor_revenue_yoy_rank,
       semiconductor_health_score_rank
FROM {focus}
ORDER BY month DESC NULLS LAST
LIMIT :months
"""


def high_risk(snapshot: DataFrame, labels: Sequence[str] = HIGH_RISK_LABELS) -> DataFrame:
    return snapshot.sparkSession.sql(HIGH_RISK, args={"labels": list(labels)}, snapshot=snapshot)


def latest_peers(peers: DataFrame) -> DataFrame:
    return peers.sparkSession.sql(LATEST_PEERS, peers=peers)


def top_growth(growth: DataFrame) -> DataFrame:
    return growth.sparkSession.sql(TOP_GROWTH, growth=growth)


def focus_history(focus: DataFrame, months: int = FOCUS_MONTHS) -> DataFrame:
    return focus.sparkSession.sql(FOCUS_HISTORY, args={"months": months}, focus=focus)
