from datetime import date

import pytest
from pyspark.sql import functions as F

from marketloom.functions import dates, formats, rules, text


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [row.r for row in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]

    return run


def test_trade_date(apply):
    cases = {
        "113/02/03": date(2024, 2, 3),
        "2024/02/03": date(2024, 2, 3),
        "1130203": date(2024, 2, 3),
        "20240203": date(2024, 2, 3),
        "2024-02-03": date(2024, 2, 3),
        "2024-02-03 10:00:00": date(2024, 2, 3),
        " 2024.02.03 ": date(2024, 2, 3),
        "113/2/29": date(2024, 2, 29),
        "113/02/30": None,
        "1131332": None,
        "2024-13-01": None,
        "garbage": None,
        "": None,
        "12345": None,
        None: None,
    }
    assert apply(dates.trade_date, list(cases)) == list(cases.values())


def test_statement_date_keeps_unknown_text(apply):
    cases = {
        "1130331": "2024-03-31",
        "2024-03-31": "2024-03-31",
        "2024/3/31": "2024-03-31",
        "2024Q2": "2024-04-01",
        "113Q1": "113Q1",
        "soon": "soon",
        None: None,
    }
    assert apply(dates.statement_date, list(cases)) == list(cases.values())


def test_feed_month(apply):
    cases = {"11302": "2024-02", "11302.0": "2024-02", "202402": "2024-02", "202413": None, "x": None, None: None}
    assert apply(dates.feed_month, list(cases)) == list(cases.values())


def test_latest_friday(apply):
    days = [date(2024, 3, d) for d in range(1, 9)]  # 2024-03-01 is a Friday
    assert apply(dates.latest_friday, days, "date") == [date(2024, 3, 1)] * 7 + [date(2024, 3, 8)]


def test_price_numbers(apply):
    cases = {
        "1,234.50": 1234.5, "+1.5": 1.5, "-0.25": -0.25, " 7 ": 7.0, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "--": None,
        "-": None, "nan": None, "NaN": None, "": None, "X0.00": None, "1.0d": None, "Infinity": None, "0x1p3": None,
        "1_000": None, None: None,
    }
    assert apply(lambda c: text.number(text.price_text(c)), list(cases)) == list(cases.values())
    assert apply(text.plain_number, ["1,000", "abc", "2.5"]) == [1000.0, None, 2.5]


def test_normalize_id(apply):
    assert apply(text.normalize_id, [" 2330.0 ", "2330", "0050", "10.05", None]) == [
        "2330", "2330", "0050", "10.05", None,
    ]


def test_metric_names(apply):
    assert apply(rules.metric_name, ["EPS", "權益總計", "Other Income Net"]) == [
        "earnings_per_share", "total_equity", "other_income_net",
    ]


def test_risk_levels(apply):
    assert apply(rules.risk_level, [85, 75, 65, 64, None], "int") == ["Low", "Mid", "High", "Watch", "Watch"]


def test_growth_signal(spark):
    cases = [
        (None, None, "Unknown"), (0.1, 0.3, "Strong Growth"), (-0.1, 0.3, "Improving"), (None, 0.3, "Improving"),
        (0.1, 0.2, "Improving"), (-0.1, -0.1, "Declining"), (0.1, -0.1, "Mixed"), (0.1, None, "Mixed"),
        (-0.1, None, "Mixed"), (0.0, 0.0, "Mixed"),
    ]
    df = spark.createDataFrame(cases, "mom double, yoy double, expected string")
    got = df.select(rules.growth_signal(F.col("mom"), F.col("yoy")).alias("s"), "expected").collect()
    assert [row.s for row in got] == [row.expected for row in got]


def score_by_hand(yoy, mom, above, vol, pe, dividend):
    score = 50
    if yoy is not None:
        score += 20 if yoy > 0.2 else 10 if yoy >= 0.05 else 5 if yoy >= 0 else -15
    if mom is not None:
        score += 5 if mom > 0.05 else -5 if mom < -0.05 else 0
    if above is not None:
        score += 10 if above else -5
    if vol is not None:
        score += -10 if vol > 0.05 else -5 if vol >= 0.03 else 5
    if pe is not None:
        score += 10 if 8 <= pe <= 25 else -10 if pe > 40 else 0
    if dividend is not None and dividend > 0:
        score += 5
    return max(0, min(100, score))


def test_health_score_over_all_branches(spark):
    import itertools

    cases = list(
        itertools.product(
            [None, 0.3, 0.2, 0.05, 0.0, -0.1], [None, 0.1, 0.05, -0.1], [None, True, False],
            [None, 0.06, 0.05, 0.03, 0.02], [None, 5.0, 8.0, 25.0, 30.0, 41.0], [None, 0.0, 2.0],
        )
    )
    df = spark.createDataFrame(
        [(i, *case) for i, case in enumerate(cases)],
        "i int, yoy double, mom double, up boolean, vol double, pe double, dy double",
    )
    score = rules.health_score(*[F.col(name) for name in ("yoy", "mom", "up", "vol", "pe", "dy")])
    got = {row.i: row.s for row in df.select("i", score.alias("s")).collect()}
    assert got == {i: score_by_hand(*case) for i, case in enumerate(cases)}
    best = cases.index((0.3, 0.1, True, 0.02, 25.0, 2.0))
    assert got[best] == 100  # 105 before the clamp


def test_industry_labels(apply):
    assert apply(rules.industry_label, ["24", "01", "1", " 17 ", "Semiconductor", "99", None]) == [
        "Semiconductor", "Cement", "Cement", "Financial and Insurance", "Semiconductor", "99", "Unknown",
    ]


def test_report_text(apply):
    assert apply(formats.percent_text, [0.1234, 12.5, -0.5, None], "double") == ["12.34%", "1250.00%", "-50.00%", "N/A"]
    assert apply(formats.whole_text, [1234567.6, None], "double") == ["1,234,568", "N/A"]
    assert apply(formats.price_text, [1234.5, None], "double") == ["1,234.50", "N/A"]


def test_not_a_number_is_missing_to_score_and_signal(spark):
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    flag = F.lit(None).cast("boolean")
    row = spark.range(1).select(
        rules.health_score(nan, nan, flag, nan, nan, nan).alias("a"), rules.health_score(none, none, flag, none, none, none).alias("b"),
        rules.growth_signal(nan, nan).alias("c"), rules.growth_signal(F.lit(0.1), nan).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (50, 50, "Unknown", "Mixed")
