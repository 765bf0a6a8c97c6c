from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators.series import add_revenue_growth
from marketloom.plans import silver
from marketloom.sources import readers


def days(count, start=date(2024, 1, 1)):
    return [start + timedelta(days=i) for i in range(count)]


def test_price_features_of_a_rising_stock(text_frame, rows):
    feed = text_frame(
        [
            dict(date=day, stock_id="2344", open=10 + i, max=11 + i, min=9 + i, close=10 + i, Trading_Volume=1000,
                 Trading_money=10000)
            for i, day in enumerate(days(65))
        ]
    )
    result = rows(silver.price_table(silver.clean_prices([feed])), "date")
    assert len(result) == 65
    assert result[1]["daily_return"] == pytest.approx(0.1)
    assert result[19]["ma_20"] == 19.5
    assert result[64]["ma_60"] == pytest.approx(sum(range(15, 75)) / 60)
    assert result[64]["volatility_20d"] is not None
    february = [row for row in result if row["date"] == date(2024, 2, 1)][0]
    assert february["monthly_return"] == pytest.approx((69 - 40) / 40)
    assert result[0]["monthly_return"] is None and result[0]["volatility_20d"] is None
    assert result[0]["price_above_ma20_flag"] is False and result[64]["price_above_ma60_flag"] is True


def test_price_feeds_unify_and_the_last_source_wins(text_frame, rows):
    snapshot = text_frame([dict(Code="2330", snapshot_date="1130203", ClosingPrice="1,000.50", Change="+1.5")])
    history = text_frame(
        [
            {"stock_id": "2330.0", "日期": "113/02/03", "收盤價": "1001", "漲跌價差": "X0.00"},
            {"stock_id": "2330", "日期": "113/02/30", "收盤價": "1"},
            {"stock_id": None, "日期": "113/02/04", "收盤價": "1"},
            {"stock_id": "0050", "日期": "113/02/04", "收盤價": "1"},
        ]
    )
    only_history = rows(silver.clean_prices([snapshot, history]))
    assert [(r["stock_id"], r["date"], r["close_price"], r["price_change"]) for r in only_history] == [
        ("2330", date(2024, 2, 3), 1001.0, None)
    ]
    third = text_frame([dict(date="2024-02-03", stock_id="2330", close="--", spread="-0.5")])
    (row,) = rows(silver.clean_prices([snapshot, history, third]))
    assert row["close_price"] is None and row["price_change"] == -0.5  # the whole row wins, with its nulls


def test_landing_order_decides_within_a_feed(text_frame, rows):
    feed = text_frame([dict(date="2024-01-02", stock_id="1", close=close) for close in (1, 2, 3)])
    ordered = feed.withColumn("landing_order", F.col("close").cast("bigint"))
    assert rows(silver.clean_prices([ordered]))[0]["close_price"] == 3.0
    backwards = feed.withColumn("landing_order", 10 - F.col("close").cast("bigint"))
    assert rows(silver.clean_prices([backwards]))[0]["close_price"] == 1.0


def test_zero_and_null_closes_give_null_returns(text_frame, rows):
    closes = ["0", "5", "--", "6", "6"]
    feed = text_frame([dict(date=day, stock_id="1", close=c) for day, c in zip(days(5), closes)])
    result = rows(silver.price_table(silver.clean_prices([feed])), "date")
    assert [row["daily_return"] for row in result] == [None, None, None, None, 0.0]
    assert result[3]["ma_20"] == pytest.approx(11 / 3)  # nulls do not count
    assert result[2]["price_above_ma20_flag"] is False


def test_date_bounds_apply_after_the_features(text_frame, rows):
    feed = text_frame([dict(date=day, stock_id="1", close=10 + i) for i, day in enumerate(days(60))])
    clean = silver.clean_prices([feed])
    full = {row["date"]: row for row in rows(silver.price_table(clean))}
    cut = rows(silver.price_table(clean, "2024-02-01", "2024-02-10"))
    assert len(cut) == 10
    assert all(row == full[row["date"]] for row in cut)  # first day keeps its history, last day its month end


def test_plain_revenue_growth(text_frame, rows):
    months = [date(2023 + i // 12, i % 12 + 1, 1) for i in range(13)]
    feed = text_frame([dict(date=m, stock_id="2344", revenue=100 if i < 12 else 125) for i, m in enumerate(months)])
    result = rows(silver.revenue_table(silver.clean_revenue([feed])), "month")
    assert result[12]["revenue_yoy"] == 0.25
    assert result[12]["revenue_growth_signal"] == "Strong Growth"
    assert result[0]["revenue_growth_signal"] == "Unknown"


def test_revenue_feeds_units_months_and_reported_growth(text_frame, rows):
    stated = text_frame(
        [
            {"資料年月": "11302", "公司代號": "1", "營業收入-當月營收": "1,500", "營業收入-上月比較增減(%)": "10",
             "營業收入-去年同月增減(%)": None},
            {"資料年月": "11303", "公司代號": "1", "營業收入-當月營收": "9", "營業收入-上月比較增減(%)": None,
             "營業收入-去年同月增減(%)": None},
        ]
    )
    third = text_frame(
        [
            dict(date=None, stock_id="1", revenue="7", revenue_year="2024", revenue_month="2"),
            dict(date=None, stock_id="1", revenue="3000000", revenue_year="2024", revenue_month="3"),
            dict(date="2024-05-10", stock_id="1", revenue="6000000", revenue_year="2024", revenue_month="4"),
            dict(date=None, stock_id="1", revenue="5", revenue_year=None, revenue_month="4"),
        ]
    )
    result = rows(silver.revenue_table(silver.clean_revenue([stated, third])), "month")
    assert [(r["month"], r["revenue"], r["revenue_mom"]) for r in result] == [
        ("2024-02", 1500000.0, 0.1),  # reported growth wins over the later feed
        ("2024-03", 3000000.0, 1.0),  # without it the later feed wins
        ("2024-05", 6000000.0, 1.0),  # the date beats year and month
    ]


def test_revenue_nulls_pad_or_stay(spark, rows):
    data = [("1", f"2024-{m:02d}", v) for m, v in ((1, 10.0), (2, None), (3, 20.0))]
    revenue = spark.createDataFrame(data, "stock_id string, month string, revenue double")
    pad = rows(add_revenue_growth(revenue), "month")
    none = rows(add_revenue_growth(revenue, fill="none"), "month")
    assert [row["revenue_mom"] for row in pad] == [None, 0.0, 1.0]
    assert [row["revenue_mom"] for row in none] == [None, None, None]
    assert pad[1]["revenue"] is None


def test_yoy_counts_rows_not_calendar_months(spark, rows):
    months = [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(15) if i != 3]
    data = [("1", m, 100.0 + i) for i, m in enumerate(months)]
    revenue = spark.createDataFrame(data, "stock_id string, month string, revenue double")
    result = rows(add_revenue_growth(revenue), "month")
    assert result[12]["revenue_yoy"] == pytest.approx(112 / 100 - 1)


def test_company_keeps_last_feed_row_and_adds_configured(spark, text_frame, rows):
    feed = text_frame(
        [
            {"公司代號": "2330", "公司名稱": "old", "產業別": "24"},
            {"公司代號": "2330", "公司名稱": "new", "產業別": "24"},
            {"公司代號": "1101", "公司名稱": "cement", "產業別": "01"},
        ]
    ).withColumn("landing_order", F.monotonically_increasing_id())
    configured = readers.securities(
        spark,
        [
            dict(stock_id="2330", stock_name="x", industry_group="y", market_type="Listed", focus_flag=True),
            dict(stock_id=9999, stock_name=" extra ", industry_group="z", market_type="Listed"),
            dict(stock_id="9999", stock_name="second", industry_group="z", market_type="Listed", focus_flag=True),
        ],
    )
    result = rows(silver.company_table(feed, configured), "stock_id")
    assert [(r["stock_id"], r["stock_name"], r["focus_flag"]) for r in result] == [
        ("1101", "cement", False), ("2330", "new", True), ("9999", "extra", False),
    ]
    alone = silver.company_table(readers.empty(spark), readers.securities(spark))
    assert alone.count() == 16
    assert alone.where("stock_id = '2344'").first().stock_name == "華邦電"


def test_wide_and_long_statements(text_frame, rows):
    wide = text_frame(
        [
            {"出表日期": "1130331", "年度": "113", "季別": "1", "公司代號": "1.0", "公司名稱": "a", "營業收入": "1,000",
             "Other Income Net": "5", "source_url": "u"},
        ]
    )
    result = rows(silver.statement_table(silver.statement_rows(wide, "income_statement")), "type")
    assert [(r["date"], r["stock_id"], r["type"], r["value"], r["normalized_metric_name"]) for r in result] == [
        ("2024-03-31", "1", "Other Income Net", 5.0, "other_income_net"),
        ("2024-03-31", "1", "營業收入", 1000.0, "operating_revenue"),
    ]
    long = text_frame(
        [{"年度": "2024", "季別": "2", "公司代號": None, "會計項目": "資產總額", "金額": None, "本期金額": "7"}]
    )
    (row,) = rows(silver.statement_table(silver.statement_rows(long, "balance_sheet")))
    assert (row["date"], row["stock_id"], row["value"]) == ("2024-04-01", "", 7.0)


def test_ratios_take_the_last_known_value_and_the_preferred_name(text_frame, rows):
    def items(category, *entries):
        frame = text_frame(
            [{"date": "2024-03-31", "stock_id": "1", "type": t, "value": v, "landing_order": i}
             for i, (t, v) in enumerate(entries)]
        ).withColumn("landing_order", F.col("landing_order").cast("bigint"))
        return silver.statement_rows(frame, category)

    income = items("income_statement", ("營業收入", "100"), ("營業收入", "200"), ("營業收入", "x"), ("Revenue", "999"),
                   ("本期淨利", "50"), ("EPS", "1.5"), ("營業毛利", None))
    balance = items("balance_sheet", ("資產總額", "0"), ("權益總計", "25"), ("流動資產", "3"), ("流動負債", "2"))
    cash = items("cash_flow_statement", ("本期淨利（淨損）", "40"))
    (row,) = rows(silver.fundamentals_table([income, balance, cash]))
    assert row["roe"] == pytest.approx(40 / 25)  # the cash flow statement comes last
    assert row["roa"] is None and row["debt_ratio"] is None  # zero and missing denominators
    assert row["operating_margin"] is None and row["gross_margin"] is None
    assert row["current_ratio"] == 1.5 and row["eps"] == 1.5
    only_null = items("income_statement", ("營業收入", "n/a"))
    assert rows(silver.fundamentals_table([only_null])) == []


def test_valuation_takes_the_last_known_per_column(text_frame, rows):
    per = text_frame(
        [
            dict(date="2024-01-02", stock_id="1", PER="10", PBR="1", dividend_yield="3"),
            dict(date="2024-01-02", stock_id="1", PER=None, PBR="2", dividend_yield="4"),
            dict(date="never", stock_id="1", PER="1", PBR="1", dividend_yield="1"),
        ]
    ).withColumn("landing_order", F.monotonically_increasing_id())
    dividends = text_frame([dict(date="2024-01-02", stock_id="1", CashEarningsDistribution="2.5")])
    (row,) = rows(silver.valuation_table(silver.clean_valuation(per, dividends)))
    assert (row["pe_ratio"], row["price_book_ratio"], row["dividend_yield"]) == (10.0, 2.0, 2.5)
    assert silver.valuation_table(silver.clean_valuation(None, dividends)).count() == 1


def test_a_stock_with_a_third_of_all_rows(spark, rows):
    """One stock-day is landed thousands of times; the last landing wins and nothing else changes."""
    hot = spark.range(3000).selectExpr(
        "'hot' AS stock_id", "'2024-01-02' AS date", "cast(id AS string) AS close", "id AS landing_order"
    )
    cold = spark.range(6000).selectExpr(
        "concat('s', id % 20) AS stock_id", "cast(date_add(date'2023-01-01', cast(id / 20 AS int)) AS string) AS date",
        "cast(10 + id % 7 AS string) AS close", "id AS landing_order",
    )
    clean = silver.clean_prices([hot.union(cold).repartition(8)])
    assert clean.count() == 6001
    assert rows(clean.where("stock_id = 'hot'"))[0]["close_price"] == 2999.0
