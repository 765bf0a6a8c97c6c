"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

The features of a text are its token unigrams and bigrams (runs of letters and digits, runs of other marks; case counts; a token
that follows itself is always the same bigram), hashed into 2 ** HASH_BITS places, as frequencies times SCALE. Training is one task over a bounded sample of labelled rows, which
streams them EPOCHS times through the FTRL-proximal update; a score is one sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import free_name, sparse_hash

HASH_BITS = 20
SAMPLE_ROWS = 8000  # labelled rows that training takes at most, chosen by hash of the id
EPOCHS = 4
SCALE = 100.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
SAME = 0x5A5A5A5A5A5A5A5A  # stands for any bigram of a token with itself
THRESHOLD = 0.3  # a text of this score or more counts as good
CACHED_WORDS = 1_000_000
TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class TokenHashes(dict):
    """64-bit hashes of tokens, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[token] = value = int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def places(text: str | None, hashes: TokenHashes) -> np.ndarray:
    """The hashed places of all unigrams and bigrams of a text, with repeats. They are odd; place 0 is the intercept's."""
    tokens = TOKENS(text or "")
    if not tokens:
        return np.empty(0, np.int64)
    one = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    two = sparse_hash(one[:-1] * np.uint64(3) + one[1:])
    two[one[:-1] == one[1:]] = SAME
    return (np.concatenate([one, two]) >> np.uint64(64 - HASH_BITS)).astype(np.int64) | 1


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights from examples (places, values, label), in the order given. No examples give zeros."""
    z, n, w = (np.zeros(1 << HASH_BITS) for _ in range(3))
    for _ in range(epochs):
        for at, value, label in examples:
            zs, ns = z[at], n[at]
            ws = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(ws @ value, -35, 35)))
            g = (p - label) * value
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * ws
            n[at] = grown
    active = np.abs(z) > L1
    w[active] = -(z[active] - np.sign(z[active]) * L1) / ((BETA + np.sqrt(n[active])) / ALPHA + L2)
    return w


def example(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values, the intercept first."""
    place, count = np.unique(at, return_counts=True)
    return np.concatenate([[0], place]), np.concatenate([[1.0], SCALE * count / max(len(at), 1)])


def score_texts(texts: list[str | None], weights: np.ndarray, hashes: TokenHashes) -> np.ndarray:
    z = np.empty(len(texts))
    for i, text in enumerate(texts):
        at = places(text, hashes)
        z[i] = weights[0] + (SCALE * weights[at].sum() / len(at) if len(at) else 0.0)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def is_held_out(doc_id: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32(id as text) leaves the remainder ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, doc_id: str = "doc_id", rows: int = SAMPLE_ROWS, wanted: Column | None = None) -> DataFrame:
    """(doc_id, label, place): at most ``rows`` labelled ids, in order of a hash of the id. Rows without id or label
    are left out; an id labelled twice has its smaller label."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    if wanted is not None:
        known = known.where(wanted)
    once = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(F.col(label)).cast("int").alias("label"))
    return once.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(rows)


def sampled_texts(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, place, text) of the sampled documents, one row per id: of several texts with one id the one with the smallest hash,
    so that the bound on ids bounds the rows. The sample is bounded by its limit, hence the broadcast."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    first = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text"))["text"]
    return texts.groupBy("doc_id", "label", "place").agg(first.alias("text"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled documents that are not held out, by one task that gets their features."""
    sample = labelled_sample(labels, label, doc_id, rows, ~is_held_out(doc_id))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        for batch in batches:
            pairs = [example(places(value, hashes)) for value in batch["text"]]
            yield pd.DataFrame(
                {
                    "place": batch["place"],
                    "doc_id": batch["doc_id"],
                    "label": batch["label"],
                    "at": [at.astype(np.int32).tobytes() for at, _ in pairs],
                    "value": [value.astype(np.float32).tobytes() for _, value in pairs],
                }
            )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = [
            (np.frombuffer(at, np.int32), np.frombuffer(value, np.float32).astype(np.float64), int(y))
            for batch in batches
            for at, value, y in zip(batch["at"], batch["value"], batch["label"])
        ]
        w = train_ftrl(examples)
        used = np.flatnonzero(w)
        yield pd.DataFrame({"at": [used.astype(np.int32).tobytes()], "w": [w[used].astype(np.float32).tobytes()]})

    texts = sampled_texts(docs, sample, doc_id, text)
    kind = dict(texts.dtypes)["doc_id"]
    features = texts.mapInPandas(featurise, f"place long, doc_id {kind}, label int, at binary, value binary")
    ordered = features.repartition(1).sortWithinPartitions("place", "doc_id", "at", "value")
    fitted = ordered.mapInPandas(fit, "at binary, w binary").first()
    weights = np.zeros(1 << HASH_BITS, np.float32)
    if fitted:
        weights[np.frombuffer(fitted["at"], np.int32)] = np.frombuffer(fitted["w"], np.float32)
    return weights


def quality_score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """The score of a text column, 0 to 1. Empty and null texts have the score of the intercept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, w = TokenHashes(), shared.value
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), w, hashes))

    return score(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with quality_score, predicted (1 if the score is at least THRESHOLD) and held_out beside their columns,
    under free names if they have such columns already. Repeated rows are scored alike; an empty table gives no rows; without labels
    every score is 0.5."""
    name, decision, held = (free_name(docs, stem) for stem in ("quality_score", "predicted", "held_out"))
    scored = docs.withColumn(name, quality_score(docs, train(docs, labels, doc_id, text), text))
    return scored.withColumns({decision: (F.col(name) >= THRESHOLD).cast("int"), held: is_held_out(doc_id)})


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of good quality, with all their columns."""
    name = free_name(docs, "quality_score")
    scored = docs.withColumn(name, quality_score(docs, train(docs, labels, doc_id, text), text))
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
