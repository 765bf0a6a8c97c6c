"""Inputs that the benchmark feeds do not hold: dirty years, empty universes, missing and odd rank values."""

import math

import pytest
from pyspark.sql import functions as F

from marketloom.functions import dates, text
from marketloom.operators.ranking import Rank, add_min_ranks
from marketloom.plans import reports
from marketloom.streaming import landing


def test_bad_years_are_null(spark):
    rows = [("2024", "3"), ("nan", "3"), ("1e20", "3"), ("2024", "inf"), ("x", None)]
    frame = spark.createDataFrame(rows, "y string, m string")
    got = [r[0] for r in frame.select(dates.year_month(F.col("y"), F.col("m"))).collect()]
    assert got == ["2024-03", None, None, None, None]


def test_separators_in_reported_percents_are_no_numbers(spark):
    frame = spark.createDataFrame([("1,234.5",), ("-3.5",), (" 7 ",), (None,)], "v string")
    assert [r[0] for r in frame.select(text.strict_number(F.col("v"))).collect()] == [None, -3.5, 7.0, None]


def test_empty_universe_keeps_everything(spark):
    stocks = spark.createDataFrame([("1", 5), ("2", 6), (None, 7)], "stock_id string, v int")
    universe = spark.createDataFrame([("2",), ("2",), ("9",)], "stock_id string")
    assert [r["v"] for r in reports.in_universe(stocks, universe).collect()] == [6]
    kept = reports.in_universe(stocks, universe.limit(0))
    assert kept.columns == stocks.columns and sorted(r["v"] for r in kept.collect()) == [5, 6, 7]


def test_latest_peers_falls_back_to_the_last_month(spark):
    rows = [("2020-01", "1", 1.0), ("2020-03", "2", 2.0), ("2020-03", "1", 1.0)]
    peers = spark.createDataFrame(rows, "month string, stock_id string, health_score_rank double")
    months = lambda span: [(r["month"], r["stock_id"]) for r in reports.latest_peers(peers, span).collect()]
    assert months(("2020-01", "2020-02")) == [("2020-01", "1")]
    assert months(("2019-01", "2019-02")) == months(None) == [("2020-03", "1"), ("2020-03", "2")]


def test_ranks_of_missing_values_and_groups(spark):
    rows = [("a", "1", math.nan), ("a", "2", 2.0), ("a", "3", 1.0), ("a", "4", None), (None, "5", 1.0), ("a", "6", 2.0)]
    frame = spark.createDataFrame(rows, "g string, stock_id string, v double")
    ranked = add_min_ranks(frame, ["g"], [Rank("v", "r")])
    assert {r["stock_id"]: r["r"] for r in ranked.collect()} == {"1": None, "2": 1.0, "3": 3.0, "4": None, "5": None, "6": 1.0}


def test_history_takes_the_last_landed_row_by_default(spark):
    schema = "stock_id string, day string, v int, landing_order long"
    held = spark.createDataFrame([("1", "d", 0, 9)], schema)
    rows = [("1", "d", 1, 1), ("1", "d", 2, 2)]
    for incoming in (rows, rows[::-1]):
        got = landing.append_history(held, spark.createDataFrame(incoming, schema).coalesce(1), ["stock_id", "day"])
        assert [r["v"] for r in got.collect()] == [2]
