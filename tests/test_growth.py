"""Plans whose cost grew with what was repeated for each shipment, body or row."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from marketloom.functions import dates, rules
from marketloom.operators.series import add_price_features
from marketloom.plans import gold, registry, silver
from marketloom.session import fit_session
from marketloom.sources import order_feeds, readers


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    day = datetime.datetime(1996, 1, 1)
    rows = [
        (number, 1, number % 3 + 1, 10.0, 100.0 + number, 0.05, 0.02, "ANR"[number % 3], "OF"[number % 2], day + datetime.timedelta(number))
        for number in range(60)
    ]
    spark.createDataFrame(rows, order_feeds.TABLES["lineitem"]).write.parquet(f"{path}/lineitem.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def below_aggregates(df):
    return plan(df).rsplit("Aggregate", 1)[1].split("\n", 1)[1]


def test_a_filter_on_dates_of_derived_statements_stays_above_their_aggregate(spark, folder):  # F1
    feed = order_feeds.statement_feeds(spark, folder)["income_statement"]
    months = dates.month_of(dates.statement_date(F.col("出表日期")).try_cast("date"))
    wanted = feed.where(months.isNotNull())
    assert "date_format" not in below_aggregates(wanted)
    assert wanted.count() == feed.count() > 0


def test_a_foreign_session_gets_the_settings_unless_it_has_its_own(spark):  # F1
    limit, keys = "spark.sql.codegen.hugeMethodLimit", "spark.sql.requireAllClusterKeysForCoPartition"
    other = spark.newSession()
    other.conf.set(limit, "65535")
    other.conf.set(keys, "true")
    fit_session(other)
    assert (other.conf.get(limit), other.conf.get(keys)) == ("8000", "false")
    other.conf.set(limit, "9000")
    fit_session(other)
    assert other.conf.get(limit) == "9000"


def test_rejected_bodies_come_in_the_same_pass(spark, rows):  # F2
    bodies = spark.createDataFrame(
        [
            ("a", json.dumps([{"date": "d1", "volume": "1"}, None])),
            ("b", json.dumps({"stat": "OK", "fields": ["volume", "date"], "data": [["2", "d2"]]})),
            ("c", '{"data": [{"dat'),
            ("d", None),
            ("e", json.dumps({"stat": "no rows"})),
            ("f", "[]"),
        ],
        "key string, body string",
    )
    kept = readers.payload_rows(bodies, ["date", "volume"], keep_rejected=True)
    plain = readers.payload_rows(bodies, ["date", "volume"])
    rejected = readers.rejected_payloads(bodies).drop("body")
    both = plain.unionByName(rejected, allowMissingColumns=True)
    order = ("key", "date")
    assert rows(kept, *order) == rows(both, *order)
    assert [row["key"] for row in rows(rejected, "key")] == ["c", "d"]


def test_shapes_are_read_in_one_pass(spark, folder):  # F2
    text = plan(registry.payload_shapes(registry.Market(spark, folder)))
    assert "Union" not in text and text.count("collect_list") == 1


def test_months_of_bodies_are_texts_only_at_the_end(spark, folder):  # F6
    assert "date_format" not in below_aggregates(registry.csv_bodies(registry.Market(spark, folder)))


def test_moving_averages_over_gaps(spark, rows):  # F13
    first = datetime.date(2020, 1, 1)
    closes = [None if n % 7 == 3 or n < 2 else 50 + math.sin(n) * n for n in range(150)]
    prices = spark.createDataFrame([("1", first + datetime.timedelta(n), c) for n, c in enumerate(closes)], "stock_id string, date date, close_price double")
    featured = add_price_features(prices)
    assert "-59" not in plan(featured)
    for n, row in enumerate(rows(featured, "date")):
        for length in (20, 60):
            known = [c for c in closes[max(0, n - length + 1) : n + 1] if c is not None]
            expected = sum(known) / len(known) if known else None
            assert row[f"ma_{length}"] == (expected if expected is None else pytest.approx(expected, rel=1e-12))


def test_texts_of_prices_are_not_parsed_again_by_a_filter(text_frame, rows):  # F14
    feed = text_frame([
        {"stock_id": "1.0", "date": "109/01/02", "close": "5"},
        {"stock_id": "0050", "date": "109/01/02", "close": "6"},
        {"stock_id": None, "date": "109/01/02", "close": "7"},
        {"stock_id": "1", "date": "no date", "close": "8"},
    ])
    cleaned = silver.clean_prices([feed])
    assert all("regexp" not in line for line in plan(cleaned).split("\n") if "Filter" in line)
    assert [(row["stock_id"], row["close_price"]) for row in rows(cleaned)] == [("1", 5.0)]
    assert len(rows(silver.clean_prices([feed], excluded=()))) == 2


@pytest.fixture(scope="module")
def odd_market(spark, tmp_path_factory):
    """Shipments over two years, some without stock, day or amounts, some stocks unknown."""
    path = str(tmp_path_factory.mktemp("odd"))
    day = datetime.datetime(1995, 6, 1)
    rows = [
        (n, 1, None if n % 11 == 0 else n % 3 + 1, None if n % 17 == 0 else 1.0 + n % 50, None if n % 13 == 0 else 100.0 + n, (n % 10) / 100,
         None if n % 19 == 0 else (n % 8) / 100, "ANR"[n % 3], "OF"[n % 2], None if n % 23 == 0 else day + datetime.timedelta(n * 7 % 700))
        for n in range(900)
    ]
    spark.createDataFrame(rows, order_feeds.TABLES["lineitem"]).write.parquet(f"{path}/lineitem.parquet")
    suppliers = [(1, "one", 0, 1.0), (2, "two", 1, -1.0), (None, "none", 0, 0.0)]
    spark.createDataFrame(suppliers, order_feeds.TABLES["supplier"]).write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(0, 2), (1, 3)], order_feeds.TABLES["nation"]).write.parquet(f"{path}/nation.parquet")
    return registry.Market(spark, path)


def test_months_of_one_pass_equal_the_joined_tables(odd_market, rows):  # F3, F10
    m = odd_market
    tables = (m.revenue, m.company, m.prices, m.valuation, silver.fundamentals_table([m.statements]))
    order = ("stock_id", "month", "revenue")
    assert rows(m.snapshot, *order) == rows(gold.company_snapshot(gold.scored_months(*tables)), *order)
    assert rows(m.dashboard, *order) == rows(gold.dashboard_months(*tables), *order)
    assert {None, "0001"} < {row["stock_id"] for row in rows(m.dashboard)}


@pytest.mark.parametrize("name", ["snapshot", "dashboard"])
def test_one_scan_serves_prices_revenue_and_valuation(odd_market, name):  # F3, F10
    text = plan(getattr(odd_market, name))
    assert text.count("l_shipdate") > 0 and text.count("lineitem") in (0, 2) and text.count("Expand") == 0
    assert sum("Relation" in line and "l_suppkey" in line for line in text.split("\n")) == 2


def test_raw_feeds_are_dealt_by_stock_once(odd_market, rows):  # F12
    raw, company = registry.from_raw(odd_market), odd_market.company
    tables = (raw.revenue, company, raw.prices, raw.valuation, raw.fundamentals)
    found = gold.dashboard_months(*tables)
    text = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in text.split("\n") if "Exchange hashpartitioning(stock_id" in line]
    assert "FullOuter" not in text
    assert len([line for line in dealt if "REPARTITION_BY_COL" in line]) == 4
    assert len([line for line in dealt if "ENSURE_REQUIREMENTS" in line]) == 2  # the statement rows, which fold before, and the companies
    snapshot = gold.company_snapshot(gold.scored_months(*tables))
    order = ("stock_id", "month", "revenue")
    assert rows(found, *order) == rows(gold.operating_dashboard(snapshot, raw.prices, raw.fundamentals), *order) != []


def test_rows_without_stock_and_repeated_rows_take_what_a_join_gives(spark, rows):  # F12
    months = [("1", "2020-01", 5.0), ("1", "2020-01", 6.0), ("2", "2020-01", 7.0), (None, "2020-01", 8.0), ("1", None, 9.0)]
    revenue = spark.createDataFrame(months, "stock_id string, month string, revenue double")
    revenue = revenue.withColumns({name: F.lit(0.0) for name in ("revenue_mom", "revenue_yoy")})
    company = spark.createDataFrame([("1", "one")], "stock_id string, stock_name string")
    days = [("1", datetime.date(2020, 1, 2), 10.0), ("1", datetime.date(2020, 2, 3), 11.0), (None, datetime.date(2020, 1, 2), 12.0)]
    prices = add_price_features(spark.createDataFrame(days, "stock_id string, date date, close_price double"))
    prices = prices.withColumns({name: F.lit(1.0) for name in gold.DAY_PRICE_COLUMNS if name not in prices.columns})
    valuation = spark.createDataFrame([], "stock_id string, date date, pe_ratio double, dividend_yield double, price_book_ratio double")
    ratios = [("1", "2020-01-31", 0.1), ("1", "no date", 0.2), (None, "2020-01-31", 0.3), ("2", "2019-12-31", 0.4)]
    fundamentals = spark.createDataFrame(ratios, "stock_id string, date string, roe double")
    fundamentals = fundamentals.withColumns({name: F.lit(None).cast("double") for name in gold.RATIO_COLUMNS if name != "roe"})
    found = {(r["stock_id"], r["month"], r["revenue"]): r for r in rows(gold.dashboard_months(revenue, company, prices, valuation, fundamentals))}
    assert sorted(found, key=str) == sorted(months, key=str)
    assert {key: (r["close_price"], r["roe"]) for key, r in found.items()} == {
        ("1", "2020-01", 5.0): (10.0, 0.1), ("1", "2020-01", 6.0): (10.0, 0.1), ("2", "2020-01", 7.0): (None, 0.4),
        (None, "2020-01", 8.0): (12.0, 0.3), ("1", None, 9.0): (11.0, 0.2),
    }


def test_ratios_of_wide_accounts_equal_those_of_long_rows(spark, rows):  # F3, F10
    accounts = [*order_feeds.INCOME, *order_feeds.BALANCE, *order_feeds.CASH_FLOW]
    values = [[float(n + i) for i in range(len(accounts))] for n in range(4)]
    values[1] = [None] * len(accounts)
    values[2][:-1] = [None] * (len(accounts) - 1)
    ids = [("2020-03-31", "1"), ("2020-06-30", "1"), ("2020-09-30", "1"), (None, "2")]
    wide = spark.createDataFrame([(*i, *v) for i, v in zip(ids, values)], "date string, stock_id string, " + ", ".join(f"`{a}` double" for a in accounts))
    long = wide.unpivot(["date", "stock_id"], accounts, "type", "value")
    long = long.withColumn("normalized_metric_name", rules.metric_name(F.col("type")))
    expected = rows(silver.fundamentals_table([long]), "date")
    assert rows(silver.fundamentals_of_accounts(wide), "date") == expected and len(expected) == 2
    assert wide.count() == 4


def test_the_place_of_a_row_travels_once_and_without_the_folder(spark, tmp_path, rows):  # F4, F9
    quotes = spark.createDataFrame([("1", "2020-01-02", "5"), ("1", "2020-01-02", "6"), ("2", "2020-01-02", "7")], "stock_id string, date string, close string")
    quotes.repartitionByRange(2, "close").write.csv(f"{tmp_path}/q.csv", header=True)
    read = readers.read_raw(spark, f"{tmp_path}/q.csv")
    assert {"/" in row["landing_order"]["file"] for row in rows(read)} == {False}
    cleaned = silver.clean_prices([read])
    (last,) = [line for line in plan(cleaned).split("\n") if "Aggregate" in line]
    assert last.count("feed_order#") == 1
    assert [(row["stock_id"], row["close_price"]) for row in rows(cleaned, "stock_id")] == [("1", 6.0), ("2", 7.0)]


def test_files_of_several_folders_keep_their_order(spark, tmp_path, rows):  # F4, F9
    for folder, close in (("b", "6"), ("a", "5")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "q.csv").write_text(f"stock_id,date,close\n1,2020-01-02,{close}\n")
    (row,) = rows(silver.clean_prices([readers.read_raw(spark, f"{tmp_path}/*/q.csv")]))
    assert row["close_price"] == 6.0


def test_landed_csv_text_is_read_once_for_the_index(spark, tmp_path, rows):  # F5
    mark = "﻿"
    bodies = {
        "a": f'{mark}date,note\nd1,"two\nlines"\n', "b": "date,note\nd2,x\n<" + mark + "HTML>\n", "c": "", "d": "\n", "e": mark,
        "f": "date,note\nd3,page cannot be accessed\n", "g": "date,note\nd4,PAGE CANNOT BE ACCESSED\n", "h": "note,date\nz,d5\n",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_text(body, newline="")
    read = readers.read_landed_csv(spark, f"{tmp_path}/*.csv", ["date", "note"])
    assert [(row["date"], row["note"]) for row in rows(read, "date")] == [("d1", "two\nlines"), ("d3", "page cannot be accessed"), ("d5", "z")]
    text = plan(read)
    assert "Relation" in text and "text" not in text.replace("csv", "")
