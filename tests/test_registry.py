"""Every registered query against its SQL twin, and the shape of the plans."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as engine
from marketloom.plans import gold, oracles, registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")

QUERIES = registry.queries() if os.path.isdir(FOLDER) else {}
TWINS = oracles.build()


@pytest.fixture(scope="module")
def twin():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(names, rows):
    """Rows as sorted text, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]).removesuffix(" 00:00:00") for i in order) for row in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MAY_BE_EMPTY = {"signal_companies", "weak_trend"}  # no stock qualifies in the smallest tables


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql_twin(spark, twin, name):
    df = QUERIES[name](spark, FOLDER)
    result = twin.execute(TWINS[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = canonical(names, result.fetchall())
    assert canonical(df.columns, [tuple(row) for row in df.collect()]) == expected
    assert expected or name in MAY_BE_EMPTY
    for forbidden in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in plan(df)


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_price_features_take_two_exchanges(spark):
    """One for the keep-last aggregate over raw rows, combined before it, and one for all windows."""
    df = QUERIES["price_features"](spark, FOLDER)
    assert exchanges(df) == 2
    assert "Exchange SinglePartition" not in plan(df)


def test_price_scan_reads_only_what_it_needs(spark):
    scan = re.search(r"FileScan parquet \[([^]]*)\]", plan(registry.Market(spark, FOLDER).prices)).group(1)
    assert {column.split("#")[0] for column in scan.split(",")} == {
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
    }


def test_stock_filter_reaches_below_the_windows_but_a_date_filter_does_not(spark):
    prices = registry.Market(spark, FOLDER).prices

    def filters(condition):
        """Filter lines above and below the windows of the optimized plan."""
        lines = prices.where(condition)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        windows = [i for i, line in enumerate(lines) if "Window" in line]
        marked = [i for i, line in enumerate(lines) if "Filter" in line and ("0003" in line or "1999-01-04" in line)]
        return [i for i in marked if i < windows[0]], [i for i in marked if i > windows[-1]]

    above, below = filters("stock_id = '0003'")
    assert not above and below
    above, below = filters("date = date'1999-01-04'")
    assert above and not below


def test_month_end_needs_no_exchange_after_the_windows(spark):
    from marketloom.operators.latest import month_end_rows

    assert exchanges(month_end_rows(registry.Market(spark, FOLDER).prices)) == 2


def test_keep_last_combines_before_the_exchange(spark):
    assert "partial_max_by" in plan(registry.Market(spark, FOLDER).clean_prices)


@pytest.mark.parametrize("kind", [registry.Market, registry.RawMarket])
def test_dashboard_of_states_equals_dashboard_over_the_snapshot(spark, kind):
    market = kind(spark, FOLDER)
    two_passes = gold.operating_dashboard(market.snapshot, market.prices, market.fundamentals)
    one_pass = market.dashboard
    assert one_pass.schema == two_passes.schema
    assert canonical(one_pass.columns, one_pass.collect()) == canonical(two_passes.columns, two_passes.collect())


def test_dashboard_reads_each_feed_once(spark):
    text = plan(QUERIES["operating_dashboard"](spark, FOLDER))
    assert len(re.findall(r"FileScan[^\n]*lineitem", text)) <= 4
    # Averages over 20 and 60 rows are the mark of the price windows.
    assert len(re.findall(r"-59, currentrow\$\(\)\) AS ma_60|RowFrame, -59", text)) == 1


def test_gold_from_bucketed_silver_needs_no_exchange(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    snapshot = QUERIES["snapshot_bucketed"](spark, FOLDER)
    before = spark.catalog.listTables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(snapshot)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert not [table for table in before if table.name.startswith("bucketed_")]


def test_entry(spark):
    df = engine.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["date", "stock_id"]
