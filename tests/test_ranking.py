import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.rules import risk_level
from marketloom.operators import ranking
from marketloom.operators.ranking import Rank, add_min_ranks, add_risk_bands, group_medians, values_at
from marketloom.session import shared_folder


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    """Many ranges for the few rows of these tests."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 10)


@pytest.fixture(scope="module")
def sample():
    """Ties, nulls, and one month with a third of all rows, most of them on one value."""
    generator = random.Random(7)
    data = []
    for i in range(1500):
        month = "2024-01" if i % 3 == 0 else f"2024-{2 + i % 11:02d}"
        value = None if generator.random() < 0.1 else 0.5 if generator.random() < 0.4 else round(generator.uniform(-1, 1), 2)
        score = None if generator.random() < 0.05 else generator.randrange(0, 101, 5)
        data.append((month, f"{i:05d}", value, score))
    return data


SCHEMA = "month string, stock_id string, value double, score int"
RANKS = [Rank("value", "value_rank"), Rank("score", "score_rank", ascending=True)]


def pandas_ranks(frame, rank):
    value = frame[rank.value]
    if value.dtype.kind == "i":
        ordered = value
    else:
        ordered = value.astype(float)
    return ordered.groupby(frame["month"]).rank(method="min", ascending=rank.ascending)


def test_min_ranks_match_pandas(spark, sample):
    df = spark.createDataFrame(sample, SCHEMA)
    got = add_min_ranks(df, ["month"], RANKS).toPandas().sort_values("stock_id")
    frame = pd.DataFrame(sample, columns=["month", "stock_id", "value", "score"]).sort_values("stock_id")
    for rank in RANKS:
        assert got[rank.name].tolist() == pytest.approx(pandas_ranks(frame, rank).tolist(), nan_ok=True)


def test_min_ranks_of_many_distinct_values_and_integers_beyond_double(spark):
    """More values than a group has ranges; whole numbers that DOUBLE cannot tell apart; both ends of a long."""
    generator = random.Random(11)
    big = 2**60
    whole = [big + generator.randrange(50) for _ in range(600)] + [big + 1] * 200 + [-(2**63), 2**63 - 1, 0, -1, 2**53 + 1]
    data = [(f"g{i % 2}", f"{i:05d}", generator.gauss(0, 1), n) for i, n in enumerate(whole)]
    df = spark.createDataFrame(data, "month string, stock_id string, value double, whole long")
    ranks = [Rank("value", "a"), Rank("whole", "b"), Rank("whole", "c", ascending=True)]
    got = add_min_ranks(df, ["month"], ranks).toPandas().sort_values("stock_id")
    frame = pd.DataFrame(data, columns=["month", "stock_id", "value", "whole"])
    for rank in ranks[:1]:
        assert got[rank.name].tolist() == pandas_ranks(frame, rank).tolist()
    for row in got.itertuples():
        group = [n for month, _, _, n in data if month == row.month]
        assert row.b == 1 + sum(n > row.whole for n in group)
        assert row.c == 1 + sum(n < row.whole for n in group)


def test_min_ranks_of_nan_signed_zero_null_groups_and_repeated_rows(spark):
    nan = float("nan")
    data = [("a", "1", 0.0), ("a", "2", -0.0), ("a", "3", nan), ("a", "4", None), ("a", "5", 1.0), (None, "6", 5.0), ("a", "5", 1.0), ("b", None, 2.0)]
    df = spark.createDataFrame(data, "month string, stock_id string, value double")
    got = add_min_ranks(df, ["month"], [Rank("value", "down"), Rank("value", "up", ascending=True)])
    found = sorted((row.month or "-", row.stock_id or "-", row.down, row.up) for row in got.collect())
    assert found == [
        ("-", "6", None, None), ("a", "1", 3.0, 1.0), ("a", "2", 3.0, 1.0), ("a", "3", None, None), ("a", "4", None, None),
        ("a", "5", 1.0, 3.0), ("a", "5", 1.0, 3.0), ("b", "-", 1.0, 1.0),
    ]
    assert add_min_ranks(df.limit(0), ["month"], [Rank("value", "r")]).collect() == []


def test_repeated_rows_come_back_in_bounded_arrays(spark, monkeypatch):
    monkeypatch.setattr(ranking, "COPIES", 3)
    df = spark.createDataFrame([("a", "1", 1.0)] * 10 + [("a", "2", 2.0)], "month string, stock_id string, value double")
    got = add_min_ranks(df, ["month"], [Rank("value", "r", ascending=True)]).collect()
    assert sorted((row.stock_id, row.r) for row in got) == [("1", 1.0)] * 10 + [("2", 11.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_groups_and_hot_values_split_and_no_job_runs_while_planning(spark, sample):
    df = spark.createDataFrame(sample, SCHEMA)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    ranked = add_min_ranks(df, ["month"], RANKS)
    medians = group_medians(df, "month", "value", "median")
    banded = add_risk_bands(df.select("stock_id", F.col("score").alias("financial_health_score"), F.lit("?").alias("risk_level")), risk_level)
    text = plan(ranked)
    assert len(tracker.getJobIdsForGroup(None)) == before
    for line, below in zip((text + plan(medians)).splitlines(), (text + plan(medians)).splitlines()[1:]):
        assert "SinglePartition" not in line or "partial_percentile_approx" in below  # quantiles of a task, one row each
    # A window over values has the range and the slot among its keys; one over ranges sees one row per range.
    windows = [line for line in text.splitlines() if re.search(r"[+:-] Window ", line)]
    assert windows
    for line in windows:
        assert "_spread" in line or "_size" in line
    assert "partial_percentile_approx" in text and "partial_sum(_rows" in text
    assert "BroadcastNestedLoopJoin" not in text + plan(medians) and "Cartesian" not in text + plan(banded)


def test_ties_of_a_third_of_all_rows_have_a_range_of_their_own(spark):
    data = [(f"{i:05d}", 0.5 if i % 2 else i / 7919, 1) for i in range(2000)]
    rows = spark.createDataFrame(data, "stock_id string, value double, _rows int")
    ranged = ranking._with_range(rows, ranking._marks(rows, [F.col("value")])[0], F.col("value"))
    tied = ranged.where("value = 0.5").agg(F.min("_range"), F.max("_range")).first()
    assert tied[0] == tied[1] and tied[0] % 2 == 1
    widest = ranged.where("_range % 2 = 0").groupBy("_range").count().agg(F.max("count")).first()[0]
    assert widest <= 2000 // 25


def test_grouped_median_matches_pandas(spark, sample):
    data = [(None if m == "2024-05" else m, *rest) for m, *rest in sample]
    data += [("odd", "x", float("nan"), 1), ("odd", "y", 3.0, 1)]
    got = {row.month: row.median for row in group_medians(spark.createDataFrame(data, SCHEMA), "month", "value", "median").collect()}
    frame = pd.DataFrame(data, columns=["month", "stock_id", "value", "score"])
    expected = frame.groupby("month", dropna=False)["value"].median()
    assert {k: pytest.approx(v) for k, v in ((None if pd.isna(m) else m, v) for m, v in expected.items())} == got


def test_values_at_positions(spark, sample):
    generator = random.Random(5)
    values = [generator.gauss(0, 1) if i % 3 else 0.25 for i in range(900)]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 7.0)], "g string, v double")
    wanted = spark.createDataFrame([("g", 1), ("g", 450), ("g", 900), ("g", 901), ("h", 1), (None, 1)], "g string, position long")
    got = {(row.g, row.position): row.v for row in values_at(df, "g", "v", wanted).collect()}
    ordered = sorted(values)
    assert got == {("g", 1): ordered[0], ("g", 450): ordered[449], ("g", 900): ordered[899], (None, 1): 7.0}


@pytest.mark.parametrize("count", [1, 2, 3, 7, 20, 137])
def test_risk_bands(spark, count):
    generator = random.Random(count)
    scores = [None if generator.random() < 0.1 else generator.randrange(50, 101, 5) for _ in range(count)]
    data = [(f"{i:04d}", score, "?") for i, score in enumerate(scores)]
    df = spark.createDataFrame(data, "stock_id string, financial_health_score int, risk_level string")
    got = {row.stock_id: row.risk_level for row in add_risk_bands(df, risk_level).collect()}
    order = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    watch = max(1, math.ceil(count * 0.15))
    high = max(1, math.ceil(count * 0.25)) if count > watch else 0

    def own(score):
        if score is None or score < 65:
            return "Watch"
        return "Low" if score >= 85 else "Mid" if score >= 75 else "High"

    expected = {
        stock: "Watch" if i < watch else "High" if i < watch + high else own(score)
        for i, (stock, score, _) in enumerate(order)
    }
    assert got == expected


def test_risk_bands_with_a_third_on_one_score(spark):
    data = [(f"{i * 7919 % 3000:04d}", 60 if i % 3 == 0 else i % 101 or None, "?") for i in range(3000)]
    df = spark.createDataFrame(data, "stock_id string, financial_health_score int, risk_level string")
    got = {row.stock_id: row.risk_level for row in add_risk_bands(df, lambda score: F.lit("own")).collect()}
    order = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {stock: "Watch" if i < 450 else "High" if i < 1200 else "own" for i, (stock, *_) in enumerate(order)}


def test_no_companies_no_bands(spark):
    df = spark.createDataFrame([], "stock_id string, financial_health_score int, risk_level string")
    assert add_risk_bands(df, risk_level).collect() == []


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
