"""Whitening against exact arithmetic on whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, whitened string, Projected int"


def exact_covariance(fit):
    n, d = len(fit), len(fit[0])
    sums = [sum(row[i] for row in fit) for i in range(d)]
    centred = [[n * row[i] - sums[i] for i in range(d)] for row in fit]
    matrix = [[Fraction(sum(row[i] * row[j] for row in centred), n**3) for j in range(d)] for i in range(d)]
    return sums, np.array([[float(value) for value in row] for row in matrix])


def test_query_against_exact_arithmetic(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    source = {row.vec_id: [math.floor(256 * c) for c in row.embedding] for row in vectors.collect()}
    fit = [list(row) for row in {tuple(x) for x in source.values()}]
    n, (sums, matrix) = len(fit), exact_covariance(fit)
    values, unit = np.linalg.eigh(matrix)
    got = queries.QUERIES["op11_embedding_whitening"](spark, FOLDER).collect()
    assert len(got) == 4 * len(source)
    signs = {}
    for row in got:
        x, k = source[row.vec_id], len(values) - row.component
        assert row.n == n
        assert row.deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums))
        wanted = (np.array(x) - np.array(sums) / n) @ unit[:, k] / math.sqrt(values[k])
        signs.setdefault(row.component, np.sign(wanted * row.whitened))
        assert row.whitened * signs[row.component] == pytest.approx(wanted, abs=1e-8)
        assert row.explained == pytest.approx(values[k] / np.trace(matrix), rel=1e-9)
        assert 0 <= row.identity_error < 1e-9
    assert len({row.identity_error for row in got}) == 1


@pytest.mark.parametrize("scale", [1, 10**6, 10**12, 2**62])
def test_square_sums_are_exact_at_any_size(scale):
    rng = np.random.default_rng(5)
    x = rng.integers(-scale, scale + 1, (50, 5), dtype=np.int64)
    sums = [sum(column) for column in x.T.tolist()]
    centre = whitening.Centre(len(x), sums, max(abs(v) for row in x.tolist() for v in row))
    totals = {}
    for part in (x[:20], x[20:]):
        whitening.add_squares(part, centre, totals)
    centred = [[len(x) * v - s for v, s in zip(row, sums)] for row in x.tolist()]
    for i in range(5):
        for j in range(i, 5):
            wanted = sum((row[i] + (row[j] if i != j else 0)) ** 2 for row in centred)
            assert sum(int(total[i, j]) << power for power, total in totals.items()) == wanted
    assert centre.square_sums(x) == [sum(v * v for v in row) for row in centred]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0], "a", 1), (1, [0.5, 1.0], "a", 1), (2, [1.5, -1.0], None, 2), (None, [-0.25, 0.0], "c", None),
        (4, None, "", 0), (5, [nan, 1.0], "", 0), (6, [inf, 1.0], "", 0), (7, [None, 1.0], "", 0), (8, [1.0], "", 0), (9, [], "", 0),
    ]
    done = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert {"whitened", "Projected", "whitened_", "deviation", "explained", "identity_error", "fit_rows"} == set(done.columns) - {
        "vec_id", "embedding"
    }
    got = done.collect()
    assert sorted((row.vec_id or 0) for row in got) == [0, 1, 1, 2]
    assert {row.fit_rows for row in got} == {3}
    fit = [[128, 256], [384, -256], [-64, 0]]
    sums = [448, 0]
    exact = {1: fit[0], 2: fit[1], None: fit[2]}
    for row in got:
        assert int(row.deviation) == sum((3 * v - s) ** 2 for v, s in zip(exact[row.vec_id], sums))
        assert sum(row.explained) == pytest.approx(1)


def test_no_variance_no_rows_and_huge_values(spark):
    one = whitening.component_rows(spark.createDataFrame([(1, [0.5, 1.0], "", 0)] * 3, SCHEMA)).collect()
    assert len(one) == 6
    assert {(row.n, row.deviation, row.whitened, row.explained, row.identity_error) for row in one} == {(1, 0, None, None, None)}
    line = whitening.component_rows(spark.createDataFrame([(k, [k / 2, k / 2], "", 0) for k in range(5)], SCHEMA))
    flat = {row.component: row.whitened is None for row in line.collect()}
    assert flat == {1: False, 2: True}
    for empty in ([], [(1, None, "", 0)], [(1, [], "", 0)]):
        assert whitening.component_rows(spark.createDataFrame(empty, SCHEMA)).collect() == []
    huge = whitening.component_rows(spark.createDataFrame([(1, [1e30], "", 0), (2, [-1e30], "", 0)], SCHEMA)).collect()
    assert [row.deviation for row in huge] == [None, None]  # beyond a long
    assert sorted(round(row.whitened, 9) for row in huge) == [-1, 1]


def test_repeats_count_once_and_fold_before_the_shuffle(spark):
    rows = [(k, [float(k % 7), float(k % 3)], "", 0) for k in range(300)]
    once = whitening.component_rows(spark.createDataFrame(rows[:21], SCHEMA)).orderBy("vec_id", "component").collect()
    often = whitening.component_rows(spark.createDataFrame(rows + rows[:1] * 500, SCHEMA))
    often = often.where(F.col("vec_id").between(1, 20)).orderBy("vec_id", "component").collect()
    for a, b in zip(once[2:], often):
        assert (a.vec_id, a.n, a.deviation) == (b.vec_id, b.n, b.deviation)
        assert abs(a.whitened) == pytest.approx(abs(b.whitened))
