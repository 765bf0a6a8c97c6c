"""The trained text models beside plain versions: one number at a time, gradients from differences of the likelihood."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import quality, toxicity


def sentences(count, seed):
    generator = random.Random(seed)
    good, poor = [f"clear{i}" for i in range(12)], [f"spam{i}" for i in range(12)]
    rows = []
    for i in range(count):
        words = generator.choices(good if i % 3 else poor, k=generator.randrange(1, 15)) + generator.choices(["the", "and", "!!"], k=4)
        generator.shuffle(words)
        rows.append((i, " ".join(words), int(i % 3 > 0)))
    return rows + [(count, "", 1), (count + 1, None, 0)]


def plain_weights(examples):
    """Follow-the-regularised-leader, one feature after the other, on dicts."""
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for features, label in examples:
            now = {k: weight(k) for k in features}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(now[k] * v for k, v in features.items())))))
            for k, v in features.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * now[k]
                n[k] += g * g
    return {k: weight(k) for k in z}


def plain_features(text, hashes):
    """The intercept, and each unigram or bigram by its place with its frequency."""
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    found = Counter(int(p) for t in tokens for p in quality.places(t, hashes))
    for a, b in zip(tokens, tokens[1:]):
        found[int(quality.places(f"{a} {b}", hashes)[2])] += 1
    total = sum(found.values())
    return {0: 1.0} | {k: float(np.float32(quality.SCALE * c / total)) for k, c in found.items()}


def test_quality_scores_equal_those_of_a_plain_learner(spark):
    rows, hashes = sentences(80, 4), quality.TokenHashes()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int").repartition(2)
    text = {r[0]: r[1] for r in rows}
    order = quality.labelled_sample(labels, "quality", wanted=~quality.is_held_out("doc_id")).collect()
    w = plain_weights([(plain_features(text[r.doc_id], hashes), r.label) for r in sorted(order, key=lambda r: (r.place, r.doc_id))])
    assert 40 < len(order) < 80
    for r in quality.score_quality(docs, labels).collect():
        z = sum(w.get(k, 0.0) * v for k, v in plain_features(r.text, hashes).items())
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        assert r.predicted == int(r.quality_score >= 0.3)


def likelihood(w, first, gaps, texts, grades):
    """Mean log likelihood of the grades: neighbouring differences of P(grade > k)."""
    thresholds = [first]
    for gap in gaps:
        thresholds.append(thresholds[-1] + math.exp(gap))
    total = 0.0
    for words, grade in zip(texts, grades):
        z = sum(w[k] for k in words)
        above = [1.0, *(1 / (1 + math.exp(t - z)) for t in thresholds), 0.0]
        total += math.log(above[grade] - above[grade + 1])
    return total / len(grades)


def test_ordinal_steps_follow_the_likelihood(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 6)
    generator = random.Random(9)
    texts = [generator.sample(range(8), generator.randrange(0, 5)) for _ in range(40)]
    grades = [min(2, sum(k < 2 for k in words)) for words in texts]
    cells = [(i, k) for i, words in enumerate(texts) for k in words]
    got, thresholds = toxicity.fit_ordinal(np.array(grades), np.array([i for i, _ in cells]), np.array([k for _, k in cells]), 8)
    values, squares, h = [0.0] * 8 + [2.0, 0.0], [1e-8] * 10, 1e-6

    def at(k, step):
        moved = [v + step * (i == k) for i, v in enumerate(values)]
        return likelihood(moved[:8], moved[8], moved[9:], texts, grades)

    for _ in range(6):
        gradient = [-(at(k, h) - at(k, -h)) / (2 * h) for k in range(10)]
        for k, g in enumerate(gradient):
            squares[k] += g * g
            rate = toxicity.RATE / math.sqrt(squares[k])
            values[k] -= rate * g
            if k < 8:
                values[k] = math.copysign(max(abs(values[k]) - rate * toxicity.L1, 0.0), values[k])
    assert got.tolist() == pytest.approx(values[:8], abs=1e-4)
    assert thresholds.tolist() == pytest.approx([values[8], values[8] + math.exp(values[9])], abs=1e-4)


def test_severity_by_plain_sums(spark):
    generator = random.Random(2)
    calm, vile = [f"calm{i}" for i in range(30)], [f"vile{i}" for i in range(6)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(generator.choices(calm, k=9) + generator.choices(vile, k=i % 5) * (i % 4 == 0)), int(i % 4 == 0 and i % 5 > 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert 0 < model.reject <= 0.5
    for r in toxicity.score_toxicity(docs, labels).collect():
        z = sum(model.by_hash.get(toxicity.word_hash(w), 0.0) for w in toxicity.features(r.text))
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert (r.p_toxic, r.p_severe, r.severity) == pytest.approx((*p, sum(p)), abs=1e-9)
        assert r.rejected == (r.p_toxic >= model.reject)


def test_choice_of_the_rejecting_probability():
    choose = lambda toxic, p: toxicity.choose_reject(np.array(toxic), np.array(p))
    assert choose([0, 0], [0.9, 0.1]) == toxicity.REJECT == choose([], [])
    assert choose([1, 0, 1, 0], [0.9, 0.2, 0.8, 0.1]) == 0.5  # parted without error
    generator = random.Random(1)
    p = [round(generator.random(), 1) for _ in range(200)]
    toxic = [int(generator.random() < x) for x in p]
    best = max(2 * sum(t for t, x in zip(toxic, p) if x >= cut) / (sum(x >= cut for x in p) + sum(toxic)) for cut in set(p))
    assert choose(toxic, p) == pytest.approx(best / 2)


@pytest.mark.parametrize("toxic", [[], [0], [1], [1, 0, 0], [0, 1, 1, 0]])
def test_samples_too_small_to_choose_from(toxic):
    words = [np.array([k], np.int64) for k in range(len(toxic))]
    assert toxicity.fit_sample(np.array(toxic, np.int64), words).reject == toxicity.REJECT
