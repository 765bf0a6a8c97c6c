"""Embedding whitening: covariances by polarisation, in whole numbers.

Entries become whole numbers x (``rounded``). Over the distinct vectors, the fit list, Spark sums the squares of the
centred values D = n*x - S of every dimension and of D_i + D_j of every pair of dimensions. Half of what the square of a sum
exceeds the two squares by is the product sum, so all covariances follow from variances alone. All of it is exact: D is cut
into limbs of LIMB_BITS bits, whose products numpy adds in 64 bits over blocks of BLOCK_ROWS rows, and Spark adds the
blocks by power of two. Only these d * (d + 1) / 2 sums reach the driver, which divides them once and calls eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import free_name, written

SCALE = 256.0  # an entry becomes floor(SCALE * entry)
COMPONENTS = 4
LIMB_BITS = 24
BLOCK_ROWS = 2048  # products of two limb sums are below 2 ** 51, so this many of them fit 62 bits
HALF = 32
LOW = (1 << HALF) - 1
DECIMAL_LIMIT = 10**38


def is_complete(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))


def rounded(vector: Column) -> Column:
    """The entries as whole numbers. Beyond 64 bits they stop at the largest and smallest long."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(SCALE)))


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The whole-number vectors of a column as matrices of at most BLOCK_ROWS rows."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for start in range(0, len(x), BLOCK_ROWS):
            yield x[start : start + BLOCK_ROWS]


class Centre:
    """Count and sums of the fit list, and how many limbs a centred value needs."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        self.bound = n * largest + max(map(abs, sums), default=0)
        self.limbs = max(1, -(-self.bound.bit_length() // LIMB_BITS))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit integers while they fit and as Python's integers beyond."""
        if self.bound < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """The limbs of the centred values, low ones first; the highest has the sign."""
        rest, parts = self.centred(x), []
        for _ in range(self.limbs - 1):
            parts.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.int64))
            rest = rest >> LIMB_BITS
        return [*parts, rest.astype(np.int64)]

    def square_sums(self, x: np.ndarray) -> list[int]:
        """The exact sum of squared centred values of each row."""
        centred = self.centred(x)
        if len(self.sums) * self.bound**2 < 1 << 63:
            return np.einsum("ij,ij->i", centred, centred).tolist()
        return [sum(value * value for value in row) for row in centred.tolist()]


def add_squares(x: np.ndarray, centre: Centre, totals: dict[int, np.ndarray]) -> None:
    """Adds the squares of D_i (at i, i) and of D_i + D_j (at i, j) over the rows, by power of two."""
    d, parts = x.shape[1], centre.split(x)
    for i in range(d):
        sums = [part[:, i:] + part[:, i : i + 1] for part in parts]
        for pair_sum, part in zip(sums, parts):
            pair_sum[:, 0] = part[:, i]
        for a, left in enumerate(sums):
            for b in range(a, len(sums)):
                found = np.einsum("ij,ij->j", left, sums[b]) * (1 if a == b else 2)
                shift = LIMB_BITS * (a + b)
                for power, value in ((shift, found & LOW), (shift + HALF, found >> HALF)):
                    totals.setdefault(power, np.zeros((d, d), np.int64))[i, i:] += value


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x): every distinct whole-number vector once, stored. Spark folds repeats inside each task before the shuffle."""
    whole = vectors.where(is_complete(F.col(vector))).select(rounded(F.col(vector)).alias("x"))
    return written(whole.distinct())


def centre_of(fit: DataFrame) -> tuple[DataFrame, Centre]:
    """The vectors of the most frequent length (of several, the longest) with their count and sums."""
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if not found or not found["d"]:
        return fit.limit(0), Centre(0, [], 0)
    d = found["d"]
    fit = fit.where(F.size("x") == d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros((2, d), np.int64)
        least, most = np.zeros((2, d), np.int64)
        for x in matrices(batches, d):
            low += (x & LOW).sum(axis=0)
            high += (x >> HALF).sum(axis=0)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part) for part in (np.arange(d), low, high, least, most)], names=["i", "low", "high", "least", "most"]
        )

    parts = fit.mapInArrow(sums, "i long, low long, high long, least long, most long")
    rows = parts.groupBy("i").agg(F.sum("low"), F.sum("high"), F.min("least"), F.max("most")).orderBy("i").collect()
    return fit, Centre(
        found["n"], [low + (high << HALF) for _, low, high, _, _ in rows], max(max(-least, most) for *_, least, most in rows)
    )


def covariance(fit: DataFrame, centre: Centre) -> np.ndarray:
    """The covariance matrix of the fit list, each entry rounded once."""
    d = len(centre.sums)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for x in matrices(batches, d):
            add_squares(x, centre, totals)
        for power, total in totals.items():
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part) for part in (i, j, np.full(len(i), power), total[i, j])], names=["i", "j", "power", "value"]
            )

    parts = fit.mapInArrow(squares, "i long, j long, power long, value long")
    exact = np.zeros((d, d), object)
    for i, j, power, value in parts.groupBy("i", "j", "power").agg(F.sum("value")).collect():
        exact[i, j] += value << power
    cube = centre.n**3
    result = np.zeros((d, d))
    for i in range(d):
        result[i, i] = exact[i, i] / cube
        for j in range(i + 1, d):
            result[i, j] = result[j, i] = (exact[i, j] - exact[i, i] - exact[j, j]) / (2 * cube)
    return result


class Whitening:
    """The first components: unit vectors as columns, eigenvalues (falling) and shares of the total variance."""

    def __init__(self, centre: Centre, matrix: np.ndarray, components: int = COMPONENTS):
        values, vectors = np.linalg.eigh(matrix)
        order = np.argsort(-values, kind="stable")[:components]
        self.centre = centre
        self.values, self.vectors = values[order], vectors[:, order]
        tiny = len(matrix) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
        self.flat = self.values <= tiny  # no variance in this direction, so nothing to divide by
        total = float(np.trace(matrix))
        self.explained = [float(value) / total if total > 0 else None for value in self.values]
        self.scale = 1 / (centre.n * np.sqrt(np.where(self.flat, 1.0, self.values)))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x).astype(np.float64) @ self.vectors) * self.scale


def identity_error(fit: DataFrame, whitening: Whitening) -> float | None:
    """The largest distance of the whitened fit list's covariance from the identity, over components with variance."""
    live = np.flatnonzero(~whitening.flat)
    d = len(whitening.centre.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((len(live), len(live))), np.zeros(len(live))
        for x in matrices(batches, d):
            w = whitening.apply(x)[:, live]
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0]), pa.array([total.ravel().tolist()]), pa.array([mean.tolist()])], names=["at", "product", "mean"]
        )

    if not len(live):
        return None
    parts = fit.mapInArrow(products, "at long, product array<double>, mean array<double>")
    columns = [F.sum(F.col("product")[k]) for k in range(len(live) ** 2)] + [F.sum(F.col("mean")[k]) for k in range(len(live))]
    sums = np.array(parts.agg(*columns).first(), float) / whitening.centre.n
    product, mean = sums[: len(live) ** 2].reshape(len(live), -1), sums[len(live) ** 2 :]
    return float(np.abs(product - np.outer(mean, mean) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The complete vectors with their columns and, under free names if these are taken: fit_rows (distinct vectors), deviation
    (exact sum of squared centred values, DECIMAL(38, 0)), whitened and explained (an entry per component, by falling
    eigenvalue), identity_error.

    Vectors that are null or hold a null, NaN or infinite entry are left out, as are those of another length than
    most distinct vectors have (of equally frequent lengths, the longest counts). Repeated rows stay and get equal values, but count
    once in the fit. A component without variance has null whitened values; without any variance explained and identity_error are
    null, too. A deviation of more than 38 digits is null. An empty table, or one of empty vectors, gives no rows.
    """
    names = {stem: free_name(vectors, stem) for stem in ("fit_rows", "deviation", "whitened", "explained", "identity_error")}
    fit, centre = centre_of(fit_list(vectors, vector))
    d = len(centre.sums)
    whitening = Whitening(centre, covariance(fit, centre), components) if d else None
    error = identity_error(fit, whitening) if d else None

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xs in batches:
            x = np.stack(xs.to_list()) if len(xs) else np.zeros((0, d), np.int64)
            found = whitening.apply(x)
            if whitening.flat.any():
                found = found.astype(object)
                found[:, whitening.flat] = None
            exact = [Decimal(value) if value < DECIMAL_LIMIT else None for value in centre.square_sums(x)]
            yield pd.DataFrame({"deviation": pd.Series(exact, dtype=object), "whitened": list(found)})

    both = free_name(vectors, "projected")
    kept = vectors.where(is_complete(F.col(vector)) & (F.size(vector) == d) & F.lit(d > 0))
    if d:
        kept = kept.withColumn(both, project(rounded(F.col(vector))))
    else:
        kept = kept.withColumn(both, F.lit(None).cast("struct<deviation: decimal(38,0), whitened: array<double>>"))
    shares = F.array(*[F.lit(share).cast("double") for share in (whitening.explained if d else [])])
    return kept.withColumns(
        {
            names["fit_rows"]: F.lit(centre.n).cast("long"),
            names["deviation"]: F.col(both)["deviation"],
            names["whitened"]: F.col(both)["whitened"],
            names["explained"]: shares.cast("array<double>"),
            names["identity_error"]: F.lit(error).cast("double"),
        }
    ).drop(both)


def component_rows(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per complete vector and component: vec_id, component (from 1), n, deviation (null beyond a long), whitened,
    explained, identity_error."""
    done = whiten(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding")))
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair")
    return done.select("vec_id", "fit_rows", "deviation", "identity_error", pairs).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.col("fit_rows").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("pair")["whitened"].alias("whitened"),
        F.col("pair")["explained"].alias("explained"),
        "identity_error",
    )
