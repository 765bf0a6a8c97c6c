import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.plans import pipeline, silver
from marketloom.sources import readers, writers
from marketloom.streaming import landing


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_absent_and_empty_raw_files_are_empty_tables(spark, tmp_path):
    assert readers.read_raw(spark, f"{tmp_path}/none.csv").count() == 0
    put(tmp_path, "empty.csv", "")
    assert readers.read_raw(spark, f"{tmp_path}/empty.csv").count() == 0
    assert readers.read_raw_files(spark, f"{tmp_path}/none_*.csv").count() == 0


def test_raw_columns_stay_text_and_keep_their_order(spark, tmp_path, rows):
    lines = "\n".join(f"{i:04d},{i}" for i in range(50))
    put(tmp_path, "feed.csv", f"Code,ClosingPrice\n{lines}\n\"0099\",\"1,234.50\"\n")
    df = readers.read_raw(spark, f"{tmp_path}/feed.csv")
    assert {kind for name, kind in df.dtypes if name != "landing_order"} == {"string"}
    result = rows(df, "landing_order")
    assert [row["Code"] for row in result] == [f"{i:04d}" for i in range(50)] + ["0099"]
    assert result[-1]["ClosingPrice"] == "1,234.50"


def test_files_with_different_headers_unite_by_name(spark, tmp_path, rows):
    put(tmp_path, "d_1.csv", "a,b\n1,2\n", encoding="utf-8-sig")
    put(tmp_path, "d_2.csv", "b,c\n3,4\n5,6\n")
    put(tmp_path, "d_3.csv", "a,b\n7,8\n")
    put(tmp_path, "d_4.csv", "")
    df = readers.read_raw_files(spark, f"{tmp_path}/d_*.csv", lineage="source_url")
    got = {(r["a"], r["b"], r["c"], r["source_url"].rsplit("/", 1)[1]) for r in rows(df)}
    assert got == {
        ("1", "2", None, "d_1.csv"), (None, "3", "4", "d_2.csv"), (None, "5", "6", "d_2.csv"), ("7", "8", None, "d_3.csv"),
    }
    same = readers.read_raw_files(spark, f"{tmp_path}/d_[13].csv", lineage="file")
    ids = same.select(readers.entity_id("d", F.col("file")).alias("id")).distinct()
    assert {row.id for row in ids.collect()} == {"1", "3"}


def test_landed_json_shapes(spark, tmp_path, rows):
    put(tmp_path, "a.json", json.dumps([{"date": "1", "x": 2}, {"date": "3"}]))
    put(tmp_path, "b.json", json.dumps({"msg": "success", "data": [{"date": "4", "x": "5"}]}))
    put(tmp_path, "c.json", json.dumps({"stat": "OK", "fields": ["x", "date"], "data": [["7", "6"]]}))
    put(tmp_path, "d.json", json.dumps({"stat": "no data", "fields": ["x", "date"], "data": [["9", "8"]]}))
    put(tmp_path, "e.json", json.dumps({"msg": "limit reached"}))
    put(tmp_path, "f.json", "not json")
    bodies = readers.read_bodies(spark, f"{tmp_path}/*.json")
    got = [(r["date"], r["x"]) for r in rows(readers.payload_rows(bodies, ["date", "x"]), "date")]
    assert got == [("1", "2"), ("3", None), ("4", "5"), ("6", "7")]


def test_odd_json_bodies(spark, rows):
    texts = {
        "fields": '{"fields": [{"date": "1", "x": "2"}, {"x": "3"}]}',
        "repeated": '{"stat": "OK", "fields": ["x", "date", "x"], "data": [["4", "5", "6"], ["7"], ["8", "9", "10", "11"]]}',
        "answer": '{"stat": "no rows"}',
        "broken": '{"data": [',
        "cut": '[{"date": "1"',
        "other": '{"msg": "limit reached"}',
        "page": "<html>",
        "empty": "",
        "null": None,
    }
    bodies = spark.createDataFrame(list(texts.items()), "path string, body string")
    got = [(r["path"], r["date"], r["x"]) for r in rows(readers.payload_rows(bodies, ["date", "x"]), "path", "x")]
    assert got == [
        ("fields", "1", "2"), ("fields", None, "3"), ("repeated", "5", "4"), ("repeated", None, "7"), ("repeated", "9", "8"),
    ]
    rejected = {row.path for row in readers.rejected_payloads(bodies).collect()}
    assert rejected == {"broken", "cut", "other", "page", "empty", "null"}


def test_landing_order_follows_files_and_not_their_sizes(spark, tmp_path, rows):
    put(tmp_path, "p.csv/part-00000.csv", "stock_id,date,close\n1,2024-01-02,1\n1,2024-01-03,1\n")
    filler = "".join(f"9,2024-01-{2 + i % 20:02d},{i}\n" for i in range(20_000))
    put(tmp_path, "p.csv/part-00001.csv", f"stock_id,date,close\n{filler}1,2024-01-02,2\n1,2024-01-02,3\n")
    put(tmp_path, "p.csv/part-00002.csv", "stock_id,date,close\n1,2024-01-03,4\n")
    last = silver.clean_prices([readers.read_raw(spark, f"{tmp_path}/p.csv")]).where("stock_id = '0001' OR stock_id = '1'")
    assert [r["close_price"] for r in rows(last, "date")] == [3.0, 4.0]
    put(tmp_path, "q_1.csv", f"stock_id,date,close\n{filler}1,2024-01-02,5\n")
    put(tmp_path, "q_2.csv", "date,stock_id,close,open\n2024-01-02,1,6,7\n")
    both = silver.clean_prices([readers.read_raw_files(spark, f"{tmp_path}/q_*.csv")])
    assert [r["close_price"] for r in rows(both.where("stock_id LIKE '%1'"), "date")] == [6.0]


def test_folders_per_stock_are_read_back(spark, tmp_path, text_frame, rows):
    feed = text_frame([
        dict(date="2024-01-02", stock_id="0051", close="1"), dict(date="2024-01-02", stock_id="2330", close="2"),
    ])
    writers.write_raw(feed, "TaiwanStockPrice", f"{tmp_path}/raw", by_stock=True)
    put(tmp_path / "raw", "TaiwanStockPrice_7.csv", "date,stock_id,close,open\n2024-01-02,0007,3,4\n")
    read = pipeline.Lake(spark, str(tmp_path)).feed("TaiwanStockPrice", per_stock=True)
    assert [(r["stock_id"], r["close"]) for r in rows(read, "stock_id")] == [("0007", "3"), ("0051", "1"), ("2330", "2")]
    assert silver.clean_prices([read]).count() == 3


def test_tables_are_saved_in_the_catalog(spark, tmp_path, rows):
    df = spark.createDataFrame([("2024-01", "1", 1.5, None, -0.25, "Mixed")], schemas.SILVER_MONTHLY_REVENUE)
    tables = {"silver_monthly_revenue": schemas.SILVER_MONTHLY_REVENUE, "silver_company": schemas.SILVER_COMPANY}
    writers.write_table(df, "silver_monthly_revenue", str(tmp_path))
    try:
        assert writers.publish_tables(spark, tables, str(tmp_path)) == ["silver_monthly_revenue"]
        assert rows(spark.table("silver_monthly_revenue")) == rows(df)
        assert readers.missing_tables(spark, tables) == ["silver_company"]
    finally:
        spark.sql("DROP TABLE IF EXISTS silver_monthly_revenue")


def test_landed_csv_bodies(spark, tmp_path, rows):
    wide = ",".join(f"c{i}" for i in range(300))
    put(tmp_path, "good.csv", '﻿id,name,amount\r\n1,"a, ""b""\nc","1,000"\r\n,x,\r\n2\r\n')
    put(tmp_path, "wide.csv", f"{wide},id\n{wide.replace('c', '')},w\n")
    put(tmp_path, "page.csv", "<HTML>busy</HTML>")
    put(tmp_path, "error.csv", "THE PAGE CANNOT BE ACCESSED")
    put(tmp_path, "empty.csv", "")
    bodies = readers.read_bodies(spark, f"{tmp_path}/*.csv")
    accepted = readers.accepted_bodies(bodies)
    assert accepted.count() == 2
    rejected = {row.path.rsplit("/", 1)[1] for row in readers.rejected_bodies(bodies).collect()}
    assert {"page.csv", "error.csv"} <= rejected
    result = rows(readers.read_landed_csv(spark, f"{tmp_path}/*.csv", ["id", "name", "amount", "absent"]))
    got = {(r["id"], r["name"], r["amount"], r["absent"]) for r in result}
    assert got == {
        ("1", 'a, "b"\nc', "1,000", None), (None, "x", None, None), ("2", None, None, None), ("w", None, None, None),
    }
    nothing = readers.read_landed_csv(spark, f"{tmp_path}/none*.csv", ["id"])
    assert nothing.columns == ["id"] and nothing.count() == 0


def test_six_statement_templates_take_one_header_pass(spark, tmp_path, rows, monkeypatch):
    raw = tmp_path / "raw"
    for template in range(6):
        put(raw, f"TWSEIncomeStatement_{template}.csv", f"出表日期,公司代號,項目{template},營業收入\n1130331,000{template},{template},5\n")
    passes = []
    index = readers.header_layouts
    monkeypatch.setattr(readers, "header_layouts", lambda *args: passes.append(args) or index(*args))
    read = pipeline.Lake(spark, str(tmp_path)).statements("TWSEIncomeStatement")
    got = rows(read, "公司代號")
    assert len(passes) == 1 and len(got) == 6
    assert [(r["公司代號"], r["營業收入"], r[f"項目{i}"]) for i, r in enumerate(got)] == [(f"000{i}", "5", str(i)) for i in range(6)]
    assert [r["source_url"].rsplit("_", 1)[1] for r in got] == [f"{i}.csv" for i in range(6)]
    text = read._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan csv") == 1 and text.count("FileScan text") == 1


def test_headers_with_a_mark_repeated_lines_and_equal_names(spark, tmp_path, rows):
    put(tmp_path, "d_1.csv", "a,b,a,\n1,2,3,4\n", encoding="utf-8-sig")
    put(tmp_path, "d_2.csv", 'b,"c, d"\n5,"6\n7"\n')
    df = readers.read_raw_files(spark, f"{tmp_path}/d_*.csv", multiline=True)
    assert set(df.columns) == {"a", "b", "c, d", "landing_order"}
    assert {(r["a"], r["b"], r["c, d"]) for r in rows(df)} == {("1", "2", None), (None, "5", "6\n7")}


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_tables_round_trip(spark, tmp_path, rows, file_format):
    df = spark.createDataFrame(
        [("2024-01", "1", 1.5, None, -0.25, "Mixed"), ("2024-02", "0050", None, 0.1, None, "Unknown")],
        schemas.SILVER_MONTHLY_REVENUE,
    )
    writers.write_table(df, "silver_monthly_revenue", str(tmp_path), file_format, sort=("month", "stock_id"))
    back = readers.read_table(spark, str(tmp_path), "silver_monthly_revenue", schemas.SILVER_MONTHLY_REVENUE)
    assert back.dtypes == df.dtypes and rows(back, "month") == rows(df, "month")


def test_partitioned_table_keeps_month_text(spark, tmp_path, rows):
    data = [(f"2024-{i % 12 + 1:02d}", str(i), float(i), None, None, "Mixed") for i in range(100)]
    df = spark.createDataFrame(data, schemas.SILVER_MONTHLY_REVENUE)
    writers.write_table(df, "t", str(tmp_path), partition="month", sort=("stock_id",))
    back = readers.read_table(spark, str(tmp_path), "t", schemas.SILVER_MONTHLY_REVENUE)
    assert rows(back, "stock_id") == rows(df, "stock_id")
    one = back.where("month = '2024-03'")
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().toString()


def test_missing_table_is_empty_and_listed(spark, tmp_path):
    table = readers.read_table(spark, str(tmp_path), "gold_none", schemas.GOLD_PEERS)
    assert table.count() == 0 and table.columns == schemas.GOLD_PEERS.names
    assert readers.missing_tables(spark, ["gold_none"], str(tmp_path)) == ["gold_none"]
    assert readers.missing_tables(spark, ["no_such_table"]) == ["no_such_table"]


def test_securities_from_files(spark, tmp_path):
    stocks = [{"stock_id": 2330, "stock_name": " a ", "industry_group": "24", "market_type": "Listed"}]
    path = put(tmp_path, "s.json", json.dumps({"stocks": stocks}))
    assert readers.load_securities(spark, path).first().stock_name == "a"
    yaml = pytest.importorskip("yaml")
    path = put(tmp_path, "s.yml", yaml.safe_dump({"stocks": stocks}))
    assert readers.load_securities(spark, path).first().stock_id == "2330"


def test_incremental_landing(spark, rows):
    held = spark.createDataFrame([("1", "10", "2024-01-05")], "Code string, ClosingPrice string, snapshot_date string")
    new = spark.createDataFrame([("1", "10"), ("1", "10"), ("2", "20")], "Code string, ClosingPrice string")
    grown = landing.append_snapshot(held, new, "2024-01-12")
    assert grown.count() == 3
    assert landing.append_snapshot(grown, new, "2024-01-12").count() == 3

    schema = "stock_id string, `日期` string, v string, landing_order long"
    held = spark.createDataFrame([("1", "d1", "old", 1), ("1", "d2", "old", 2)], schema)
    new = spark.createDataFrame([("1", "d2", "new", 1), ("1", "d3", "new", 2)], schema)
    assert [r["v"] for r in rows(landing.append_history(held, new), "日期")] == ["old", "new", "new"]
    with pytest.raises(ValueError):
        landing.append_history(held.drop("landing_order"), new)

    stocks = spark.createDataFrame([("1",), ("2",)], "stock_id string")
    done = spark.createDataFrame([("1", "2010-02"), ("2", None)], "stock_id string, query_month string")
    day = lambda text: F.lit(text).cast("date")
    plan = landing.missing_months(stocks, done, day("2009-06-15"), day("2010-03-20"))
    assert [tuple(r.values()) for r in rows(plan, "stock_id", "query_month")] == [
        ("1", "2010-01"), ("1", "2010-03"), ("2", "2010-01"), ("2", "2010-02"), ("2", "2010-03"),
    ]
    assert landing.missing_months(stocks, done, day("2024-02-01"), day("2024-01-31")).count() == 0


def test_merging_rewrites_only_months_that_change(spark, tmp_path, rows):
    path = str(tmp_path / "history")
    schema = "stock_id string, date string, v int, seq int, query_month string"

    def files():
        return {(p.parent.name, p.name, p.stat().st_mtime_ns) for p in (tmp_path / "history").glob("*/*.parquet")}

    def merge(*data):
        landing.merge_history(spark.createDataFrame(list(data), schema), path, ["stock_id", "date"], ["seq"])

    merge(("1", "2024-01-02", 1, 1, "2024-01"), ("1", "2024-02-02", 2, 1, "2024-02"), ("2", "2024-02-02", None, 1, "2024-02"))
    before = files()
    load = [("1", "2024-02-02", 8, 1, "2024-02"), ("1", "2024-02-02", 9, 2, "2024-02"), ("3", "2024-03-01", 5, 1, "2024-03")]
    merge(*load)
    after = files()
    assert {f for f in before if f[0].endswith("01")} == {f for f in after if f[0].endswith("01")}
    assert not {f for f in before if f[0].endswith("02")} & after
    merge(*load[::-1])
    assert files() == after
    got = rows(spark.read.parquet(path), "stock_id", "date")
    assert [(r["stock_id"], r["date"], r["v"]) for r in got] == [
        ("1", "2024-01-02", 1), ("1", "2024-02-02", 9), ("2", "2024-02-02", None), ("3", "2024-03-01", 5),
    ]
    with pytest.raises(ValueError):
        landing.merge_history(spark.createDataFrame(load, schema), path, ["stock_id", "date"], [])


@pytest.mark.parametrize("buckets", [None, 3])
def test_whole_run_from_raw_files_to_views(spark, tmp_path, rows, buckets):
    raw = tmp_path / "raw"
    start = date(2023, 11, 1)
    put(raw, "TWSECompanyInfo.csv", "公司代號,公司名稱,產業別,上市別\n2344,Winter,24,L\n2330,Tall,24,L\n2881,Bank,17,L\n")
    put(raw, "TWSEStockDayAll.csv", "Code,ClosingPrice,snapshot_date\n2344,99,2024-03-01\n0050,5,2024-03-01\n")
    for place, stock in enumerate(("2344", "2330", "2881")):
        lines = [f"{start + timedelta(days=i)},{stock},{10 + place + i % 7}" for i in range(130)]
        put(raw, f"TaiwanStockPrice_{stock}.csv", "date,stock_id,close\n" + "\n".join(lines) + "\n")
        months = [f"{2022 + m // 12}-{m % 12 + 1:02d}-01,{stock},{100 + m * (place + 1)}" for m in range(26)]
        put(raw, f"TaiwanStockMonthRevenue_{stock}.csv", "date,stock_id,revenue\n" + "\n".join(months) + "\n")
    put(raw, "TWSEMonthlyRevenue.csv", "資料年月,公司代號,營業收入-當月營收,營業收入-去年同月增減(%)\n11302,2344,\"1,000\",50\n")
    put(raw, "TWSEIncomeStatement.csv", "出表日期,公司代號,營業收入,本期淨利（淨損）\n1130331,2344,\"1,000\",100\n")
    put(raw, "TWSEBalanceSheet.csv", "出表日期,公司代號,權益總額,資產總額\n1130331,2344,500,1000\n")
    put(raw, "TaiwanStockPER_2344.csv", "date,stock_id,PER,PBR,dividend_yield\n2024-02-01,2344,12,1.5,3\n")

    lake = pipeline.Lake(spark, str(tmp_path), buckets)
    published = pipeline.run_all(lake)
    assert set(pipeline.TABLES) - set(published) == {"silver_cash_flow_statement"}
    assert readers.missing_tables(spark, schemas.GOLD_TABLES, lake.gold) == []

    last = spark.sql("SELECT * FROM gold_company_monthly_snapshot WHERE month = '2024-02' ORDER BY stock_id").collect()
    assert [row.stock_id for row in last] == ["2330", "2344", "2881"]
    focus = last[1]
    assert (focus.revenue, focus.revenue_yoy, focus.pe_ratio, focus.stock_name) == (1000000.0, 0.5, 12.0, "Winter")
    assert spark.table("silver_company").count() == 16
    ratios = spark.table("silver_fundamental_metrics").first()
    assert (ratios.date, ratios.roe, ratios.roa) == ("2024-03-31", 0.2, 0.1)
    peers = spark.sql("SELECT stock_id, revenue_yoy_rank FROM gold_semiconductor_peer_comparison WHERE month = '2024-02'")
    assert {row.stock_id: row.revenue_yoy_rank for row in peers.collect()} == {"2344": 1.0, "2330": 2.0}
    assert spark.table("gold_focus_snapshot").count() == 26
    assert spark.sql("SELECT count(*) AS n FROM silver_stock_price WHERE stock_id = '0050'").first().n == 0
    # The day that two sources hold comes from the later one.
    day = spark.sql("SELECT close_price FROM silver_stock_price WHERE stock_id = '2344' AND date = '2024-03-01'").first()
    assert day.close_price == 10 + 121 % 7


def test_feeds_survive_a_raw_csv_round_trip(spark, tmp_path, text_frame, rows):
    feed = text_frame([dict(date="2024-01-02", stock_id="1", close="1,000.5"), dict(date="2024-01-03", stock_id="1", close='"')])
    writers.write_raw(feed, "TaiwanStockPrice", str(tmp_path))
    back = readers.read_raw(spark, f"{tmp_path}/TaiwanStockPrice.csv")
    assert rows(silver.clean_prices([back]), "date") == rows(silver.clean_prices([feed]), "date")
    writers.write_raw(feed, "by_stock", str(tmp_path), by_stock=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/by_stock.csv/stock_id=1").count() == 2
