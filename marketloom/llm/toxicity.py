"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector for all grades, ordered thresholds. x marks the distinct words
of a text and their first letters. Grades are 0 (clean), 1 (toxic) and 2 (severe). Labels only tell toxic from clean, so the toxic labelled
rows are graded by marker words, those that toxic labelled rows hold far more often than clean ones: SEVERE_MARKERS or more
distinct markers are severe. The expected severity is the sum of P(grade > k). The probability from which a text is rejected is chosen within
the same sample, on a fold that the model which scores it has not learned from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import free_name
from marketloom.llm.quality import labelled_sample, sampled_texts

SAMPLE_ROWS = 12_000  # labelled rows that training takes at most, chosen by hash of the id
LEAST_TEXTS = 3  # labelled texts that must hold a word
MARKER_LOG_ODDS, SEVERE_MARKERS = 3.0, 3
STEPS, RATE, L1 = 300, 0.3, 1e-4
FOLDS = 3  # one of so many parts of the sample is scored by a model of the others, to choose the probability from which texts are rejected
REJECT = 0.5  # that probability where the sample cannot tell
STEMS = (5, 7)  # letters in the beginnings of words that are features, too
CACHED_WORDS = 1_000_000
WORDS = re.compile(r"\w+").findall


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def features(text: str | None) -> set[str]:
    """The distinct words of a text and, marked by a star, their beginnings, which stand for inflected forms."""
    words = set(WORDS((text or "").lower()))
    return words.union(*[{w[:n] + "*" for w in words if len(w) > n} for n in STEMS])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grade_rows(toxic: np.ndarray, rows: np.ndarray, words: np.ndarray, vocabulary: int) -> np.ndarray:
    """Grades of labelled rows; (rows, words) are the cells of the presence matrix."""
    bad = toxic[rows] > 0
    held = np.bincount(words[bad], minlength=vocabulary)
    clean = np.bincount(words[~bad], minlength=vocabulary)
    n_bad, n_clean = max(int((toxic > 0).sum()), 1), max(int((toxic == 0).sum()), 1)
    odds = np.log((held + 0.5) / (n_bad + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    markers = (odds >= MARKER_LOG_ODDS) & (held >= LEAST_TEXTS)
    found = np.bincount(rows, weights=markers[words], minlength=len(toxic))
    return np.where(toxic > 0, 1 + (found >= SEVERE_MARKERS), 0)


def fit_ordinal(grades: np.ndarray, rows: np.ndarray, words: np.ndarray, vocabulary: int, levels: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by proximal AdaGrad on the whole sample. Thresholds are the first one plus positive steps, so
    they stay in order."""
    count = max(len(grades), 1)
    w, first, gaps = np.zeros(vocabulary), 2.0, np.zeros(levels - 1)
    gw, gt = np.full(vocabulary, 1e-8), np.full(levels, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(rows, weights=w[words], minlength=len(grades))
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        above = sigmoid(z[:, None] - thresholds)  # P(grade > k)
        full = np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1)
        slope = full * (1 - full)
        at = np.arange(len(z))
        p = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / p / count
        dt = np.zeros((len(z), levels + 2))
        dt[at, grades] += slope[at, grades] / p / count
        dt[at, grades + 1] -= slope[at, grades + 1] / p / count
        by_threshold = dt.sum(axis=0)[1:-1]
        grad = np.bincount(words, weights=dz[rows], minlength=vocabulary)
        gw += grad * grad
        step = RATE / np.sqrt(gw)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        grad_t = np.concatenate([[by_threshold.sum()], np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(gaps)])
        gt += grad_t * grad_t
        move = RATE / np.sqrt(gt) * grad_t
        first, gaps = first - move[0], np.clip(gaps - move[1:], -5, 5)
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


class Weights(dict):
    """Weight of a word by its text, looked up by hash once and remembered up to a bound."""

    def __init__(self, by_hash: dict[int, float]):
        super().__init__()
        self.by_hash = by_hash

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = self.by_hash.get(word_hash(word), 0.0)
        return value


class Model:
    """Weights of words, thresholds of grades, and ``reject``, the probability of a grade above 0 from which a text is rejected."""

    def __init__(self, by_hash: dict[int, float], thresholds: np.ndarray, reject: float = REJECT):
        self.by_hash, self.thresholds, self.reject = by_hash, thresholds, reject

    def probabilities(self, texts: list[str | None], weights: Weights) -> np.ndarray:
        """P(grade > k), a row for each text."""
        z = np.array([math.fsum(map(weights.__getitem__, features(text))) for text in texts])
        return sigmoid(z.reshape(-1, 1) - self.thresholds)


def fit_rows(toxic: np.ndarray, hashes: list[np.ndarray]) -> Model:
    """The model of labelled rows, each with the hashes of its distinct words. Without toxic rows nothing is toxic."""
    if not (toxic > 0).any():
        return Model({}, np.array([35.0, 36.0]))
    rows = np.repeat(np.arange(len(toxic)), [len(h) for h in hashes])
    names, words = np.unique(np.concatenate(hashes), return_inverse=True)
    common = np.bincount(words) >= LEAST_TEXTS
    seen = common[words]
    names, rows, words = names[common], rows[seen], (np.cumsum(common) - 1)[words[seen]]
    w, thresholds = fit_ordinal(grade_rows(toxic, rows, words, len(names)), rows, words, len(names))
    used = np.flatnonzero(w)
    return Model(dict(zip(names[used].tolist(), w[used].tolist())), thresholds)


def choose_reject(toxic: np.ndarray, p_toxic: np.ndarray) -> float:
    """The probability from which rejecting serves F1 best: half of the best F1 that the rows allow, which holds for any calibrated
    probabilities and hangs on all rows, unlike the place of the best cut among them. Without toxic rows it is REJECT."""
    if not (toxic > 0).any():
        return REJECT
    order = np.argsort(-p_toxic, kind="stable")
    p, hits = p_toxic[order], np.cumsum(toxic[order] > 0)
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    last = p != np.append(p[1:], -1.0)  # rows of one probability stay together
    return float(f1[last].max() / 2)


def fit_sample(toxic: np.ndarray, hashes: list[np.ndarray]) -> Model:
    """The model of all rows, with ``reject`` chosen on a fold by a model of the other rows, where these tell anything."""
    fold = np.arange(len(toxic)) % FOLDS == 0
    rest = fit_rows(toxic[~fold], [h for h, held in zip(hashes, fold) if not held])
    z = [math.fsum(rest.by_hash.get(word, 0.0) for word in h.tolist()) for h, held in zip(hashes, fold) if held]
    p = sigmoid(np.array(z) - rest.thresholds[0])
    model = fit_rows(toxic, hashes)
    if rest.by_hash:
        model.reject = choose_reject(toxic[fold], p)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, wanted: Column | None = None) -> Model:
    """Learned from at most ``rows`` labelled documents by one task that gets the hashes of their distinct words."""
    sample = labelled_sample(labels, label, doc_id, rows, wanted)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.sort(np.array([word_hash(w) for w in features(t)], np.int64)) for t in batch["text"]]
            yield pd.DataFrame({"place": batch["place"], "doc_id": batch["doc_id"], "label": batch["label"], "words": [f.tobytes() for f in found]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, words = [], []
        for batch in batches:
            toxic += batch["label"].tolist()
            words += [np.frombuffer(value, np.int64) for value in batch["words"]]
        model = fit_sample(np.array(toxic, np.int64), words)
        keys = np.array(list(model.by_hash), np.int64)
        yield pd.DataFrame(
            {
                "words": [keys.tobytes()],
                "weights": [np.array(list(model.by_hash.values()), np.float64).tobytes()],
                "thresholds": [model.thresholds.tobytes()],
                "reject": [model.reject],
            }
        )

    texts = sampled_texts(docs, sample, doc_id, text)
    kind = dict(texts.dtypes)["doc_id"]
    found = texts.mapInPandas(featurise, f"place long, doc_id {kind}, label int, words binary")
    ordered = found.repartition(1).sortWithinPartitions("place", "doc_id", "words")
    row = ordered.mapInPandas(fit, "words binary, weights binary, thresholds binary, reject double").first()
    if row is None:
        return fit_rows(np.empty(0, np.int64), [])
    by_hash = dict(zip(np.frombuffer(row["words"], np.int64).tolist(), np.frombuffer(row["weights"]).tolist()))
    return Model(by_hash, np.frombuffer(row["thresholds"]), row["reject"])


def grade_probabilities(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct (p1, p2): the probabilities of a grade above 0 and above 1. Null and empty texts have those of no words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.by_hash, model.thresholds))

    @F.pandas_udf("p1 double, p2 double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = Model(*shared.value)
        weights = Weights(fitted.by_hash)
        for texts in batches:
            yield pd.DataFrame(fitted.probabilities(texts.tolist(), weights), columns=["p1", "p2"])

    return grade(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with p_toxic, p_severe, severity (expected grade), grade (likeliest) and rejected beside their columns, under
    free names if they have such columns already. Repeated rows are graded alike; an empty table gives no rows."""
    names = {stem: free_name(docs, stem) for stem in ("p_toxic", "p_severe", "severity", "grade", "rejected")}
    p = free_name(docs, "grade_probabilities")
    model = train(docs, labels, doc_id, text)
    graded = docs.withColumn(p, grade_probabilities(docs, model, text))
    above0, above1 = F.col(f"{p}.p1"), F.col(f"{p}.p2")
    likeliest = F.when((above1 >= 1 - above0) & (above1 >= above0 - above1), 2).when(above0 - above1 >= 1 - above0, 1).otherwise(0)
    return graded.withColumns(
        {
            names["p_toxic"]: above0,
            names["p_severe"]: above1,
            names["severity"]: above0 + above1,
            names["grade"]: likeliest,
            names["rejected"]: above0 >= model.reject,
        }
    ).drop(p)


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    p = free_name(docs, "grade_probabilities")
    model = train(docs, labels, doc_id, text)
    return docs.withColumn(p, grade_probabilities(docs, model, text)).where(F.col(f"{p}.p1") < model.reject).drop(p)
