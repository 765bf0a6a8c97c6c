from datetime import date

import pytest

from marketloom import schemas
from marketloom.operators.headers import conform
from marketloom.plans import gold, reports, sql_queries


@pytest.fixture(scope="module")
def peers_input(spark):
    data = [
        ("2024-01", "2344", "華邦電", "Semiconductor", 100.0, 0.2, 0.03, 0.04, 12.0, 70, "Mid"),
        ("2024-01", "2330", "台積電", "24", 200.0, 0.1, 0.01, 0.02, 20.0, 80, "Low"),
        ("2024-01", "2303", "聯電", " 半導體業 ", 10.0, None, 0.01, None, None, 70, "Mid"),
        ("2024-01", "2881", "富邦金", "Financials", 300.0, 0.5, 0.2, 0.01, 10.0, 90, "Low"),
        ("2024-01", "1101", "none", None, 300.0, 0.5, 0.2, 0.01, 10.0, 90, "Low"),
    ]
    df = spark.createDataFrame(
        data,
        "month string, stock_id string, stock_name string, industry_group string, revenue double, revenue_yoy double,"
        " monthly_return double, volatility_20d double, pe_ratio double, financial_health_score int, risk_level string",
    )
    return conform(df, schemas.GOLD_SNAPSHOT)


def test_peer_ranks(peers_input, rows):
    peers = {row["stock_id"]: row for row in rows(gold.peer_comparison(peers_input))}
    assert set(peers) == {"2344", "2330", "2303"}
    assert peers["2344"]["revenue_yoy_rank"] == 1.0 and peers["2330"]["volatility_rank"] == 1.0
    assert peers["2303"]["revenue_yoy_rank"] is None and peers["2303"]["volatility_rank"] is None
    assert [peers[s]["monthly_return_rank"] for s in ("2344", "2330", "2303")] == [1.0, 2.0, 2.0]
    assert [peers[s]["health_score_rank"] for s in ("2330", "2344", "2303")] == [1.0, 2.0, 2.0]


def test_focus_snapshot_takes_peer_ranks(peers_input, rows):
    peers = gold.peer_comparison(peers_input)
    (row,) = rows(gold.focus_snapshot(peers_input, peers))
    assert row["semiconductor_revenue_yoy_rank"] == 1.0 and row["semiconductor_health_score_rank"] == 2.0
    (outside,) = rows(gold.focus_snapshot(peers_input, peers, "2881"))
    assert outside["semiconductor_revenue_yoy_rank"] is None


@pytest.fixture(scope="module")
def tables(spark):
    revenue = spark.createDataFrame(
        [
            ("2024-01", "1", 10.0, None, None, "Unknown"), ("2024-02", "1", 20.0, 1.0, None, "Mixed"),
            ("2024-02", "2", 5.0, None, None, "Unknown"),
        ],
        "month string, stock_id string, revenue double, revenue_mom double, revenue_yoy double,"
        " revenue_growth_signal string",
    )
    company = spark.createDataFrame(
        [("1", "one", "24", "Listed", True)],
        "stock_id string, stock_name string, industry_group string, market_type string, focus_flag boolean",
    )
    prices = conform(
        spark.createDataFrame(
            [
                (date(2024, 1, 30), "1", 10.0, 0.01, True, 100.0), (date(2024, 1, 31), "1", None, 0.02, False, 200.0),
                (date(2024, 3, 1), "1", 12.0, None, None, None),
            ],
            "date date, stock_id string, close_price double, volatility_20d double, price_above_ma60_flag boolean,"
            " trading_money double",
        ),
        schemas.SILVER_STOCK_PRICE,
    )
    valuation = conform(
        spark.createDataFrame(
            [(date(2024, 1, 2), "1", 10.0, None), (date(2024, 1, 9), "1", None, 2.0)],
            "date date, stock_id string, pe_ratio double, dividend_yield double",
        ),
        schemas.SILVER_VALUATION,
    )
    fundamentals = conform(
        spark.createDataFrame(
            [("2024-02-15", "1", 0.1, None), ("2024-02-20", "1", None, 1.0), ("113Q1", "1", 9.0, 9.0)],
            "date string, stock_id string, roe double, eps double",
        ),
        schemas.SILVER_FUNDAMENTALS,
    )
    return revenue, company, prices, valuation, fundamentals


def test_snapshot_joins(tables, rows):
    result = rows(gold.company_snapshot(gold.scored_months(*tables)), "month", "stock_id")
    january, february, other = result
    assert january["close_price"] is None  # the last row of the month, not the last known value
    assert january["volatility_20d"] == 0.02 and january["price_above_ma60_flag"] is False
    assert (january["pe_ratio"], january["dividend_yield"]) == (10.0, 2.0)  # last known values
    assert january["financial_health_score"] == 50 - 5 + 5 + 10 + 5 and january["risk_level"] == "High"
    assert (february["roe"], february["eps"], february["close_price"]) == (0.1, 1.0, None)
    assert other["stock_name"] is None and other["financial_health_score"] == 50


def test_dashboard_backfills_from_the_latest_known(tables, rows):
    snapshot = gold.company_snapshot(gold.scored_months(*tables))
    january, february, other = rows(gold.operating_dashboard(snapshot, tables[2], tables[4]), "month", "stock_id")
    assert january["close_price"] == 12.0 and january["latest_price_date"] == date(2024, 3, 1)
    assert january["volatility_20d"] == 0.02 and february["volatility_20d"] == 0.02
    assert february["trading_money"] == 200.0 and february["latest_fundamental_date"] == "2024-02-20"
    assert january["eps"] == 1.0 and other["latest_price_date"] is None


def test_latest_peers_fall_back_to_the_whole_table(peers_input):
    peers = gold.peer_comparison(peers_input)
    assert reports.latest_peers(peers, ("2030-01", "2030-12")).count() == 3
    assert [row.stock_id for row in reports.latest_peers(peers, None).collect()] == ["2330", "2303", "2344"]


def test_high_risk_query_labels(peers_input):
    assert sql_queries.high_risk(peers_input).count() == 0
    assert sql_queries.high_risk(peers_input, ("Mid", "Low")).count() == 5


def test_top_rows_put_nulls_last_in_both_directions(peers_input):
    semis = peers_input.where("stock_id in ('2344', '2330', '2303')")
    assert [row.stock_id for row in reports.top_rows(semis, "revenue_yoy").collect()] == ["2344", "2330", "2303"]
    ascending = reports.top_rows(semis, "revenue_yoy", ascending=True).collect()
    assert [row.stock_id for row in ascending] == ["2330", "2344", "2303"]


def test_signal_summary(spark, rows):
    data = [
        ("2024-02", "1", None, 0.1, 0.4, "Strong Growth"), ("2024-02", "2", None, 0.1, 0.2, "Strong Growth"),
        ("2024-02", "3", 7.0, None, None, None), ("2024-01", "3", 7.0, None, None, "Mixed"),
    ]
    growth = spark.createDataFrame(
        data,
        "month string, stock_id string, revenue double, revenue_mom double, revenue_yoy double,"
        " revenue_growth_signal string",
    )
    strong, unknown = rows(reports.signal_summary(growth))
    assert strong["company_count"] == 2 and strong["median_revenue_yoy"] == pytest.approx(0.3)
    assert strong["total_revenue"] == 0.0 and strong["company_share"] == pytest.approx(2 / 3)
    assert unknown["revenue_growth_signal"] == "Unknown" and unknown["median_revenue_yoy"] is None


def test_universe_rules(spark, rows):
    dashboard = spark.createDataFrame(
        [(f"{i:02d}", f"2024-{m:02d}", date(2024, 1, i % 28 + 1), float(i)) for i in range(30) for m in range(1, 14 - i % 3)],
        "stock_id string, month string, latest_price_date date, trading_money double",
    )
    universe = reports.traded_universe(dashboard, required=["99", "29"])
    assert {row.stock_id for row in universe.collect()} == {f"{i:02d}" for i in range(10, 30)} | {"99"}
    prices = spark.createDataFrame(
        [(f"{i:02d}", date(2023, m, d)) for i in range(30) for m in range(1, 13) for d in (1, 2)], "stock_id string, date date"
    )
    qualified = reports.qualified_universe(universe, dashboard, prices, dashboard)
    assert {row.stock_id for row in qualified.collect()} == {f"{i:02d}" for i in range(10, 30) if i % 3 != 2}
    assert reports.in_universe(dashboard, None) is dashboard
