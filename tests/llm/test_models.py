import math
import zlib
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import language_model, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    return read("documents"), read("labels")


def held(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    scored = quality.score_quality(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    test = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in test]) >= 0.95
    good = [r["quality_score"] for r in test if r["quality"]]
    poor = [r["quality_score"] for r in test if not r["quality"]]
    assert np.mean([g > p for g in good for p in poor]) > 0.97


def test_quality_keeps_columns_and_survives_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 200_000, 3)], "doc_id long, text string, quality_score int"
    )
    scored = quality.score_quality(odd, labels)
    assert scored.columns == ["doc_id", "text", "quality_score", "quality_score_", "predicted", "held_out"]
    assert all(0 <= r["quality_score_"] <= 1 for r in scored.collect()) and scored.count() == 4
    none = labels.limit(0)
    assert {r["quality_score_"] for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert quality.keep_good(odd.limit(0), labels).collect() == []
    assert quality.keep_good(odd, none).columns == odd.columns


def test_ftrl_learns_a_word():
    hashes = quality.TokenHashes()
    texts = ["good day here", "bad day here"] * 30
    w = quality.train_ftrl([(*quality.example(quality.places(t, hashes)), int(t[0] == "g")) for t in texts])
    low, high = quality.score_texts(["bad day", "good day"], w, hashes)
    assert low < 0.3 < 0.7 < high


def test_toxicity_on_rows_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    learn = labels.where(~quality.is_held_out("doc_id"))
    scored = toxicity.score_toxicity(docs, learn).join(labels.where(quality.is_held_out("doc_id")), "doc_id").collect()
    clean = [r for r in scored if not r["toxic"]]
    assert sum(r["rejected"] for r in clean) <= 0.02 * len(clean)
    for r in scored:
        assert 0 <= r["p_severe"] <= r["p_toxic"] <= 1 and abs(r["severity"] - r["p_toxic"] - r["p_severe"]) < 1e-12
    toxic = [r["p_toxic"] for r in scored if r["toxic"]]
    assert np.mean([t > c["p_toxic"] for t in toxic for c in clean]) > 0.95


def test_ordinal_grades_share_weights_and_order():
    words = np.array([0, 1, 2] * 20)
    rows, grades = np.arange(60), np.array([0, 1, 2] * 20)
    w, thresholds = toxicity.fit_ordinal(grades, rows, words, 3)
    assert w[0] < w[1] < w[2] and thresholds[0] < thresholds[1]


def test_toxicity_edges(spark, tables):
    _, labels = tables
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (5, "x " * 300_000, 3)], "doc_id long, text string, grade int")
    scored = toxicity.score_toxicity(odd, labels)
    assert scored.count() == 4 and "grade_" in scored.columns
    assert toxicity.keep_clean(odd, labels.limit(0)).count() == 4
    assert toxicity.keep_clean(odd.limit(0), labels).collect() == []


def test_language_model_against_brute_force(spark, tables):
    docs, _ = tables
    scored = {r["doc_id"]: r for r in language_model.score_texts(docs).collect()}
    texts = {r["doc_id"]: language_model.tokens((r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()}
    counts = Counter()
    for doc_id, words in texts.items():
        if not held(doc_id, 7, 2):
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for doc_id, words in texts.items():
        row = scored[doc_id]
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert row["train_tokens"] == n and row["n_tokens"] == len(words) and row["held_out"] == held(doc_id, 7, 2)
        assert row["n_known"] == sum(counts[w] > 0 for w in words) and abs(row["base_score"] - base) < 1e-6
        gain += (row["score"] - base) * row["held_out"]
    assert gain > 0


def test_language_model_is_normalised():
    share = np.full(language_model.CLASSES, 1 / language_model.CLASSES)
    model = language_model.Parameters(np.random.default_rng(1).standard_normal(sum(language_model.Parameters.SIZES)).astype(np.float32))
    before = np.tile(np.array([[3], [1], [4], [1]]), (1, language_model.CLASSES))
    total = np.exp(model.log_probabilities(before, np.arange(language_model.CLASSES))).sum()
    assert abs(total - 1) < 1e-4 and len(share) == language_model.CLASSES


def test_a_training_round_steps_on_every_position_once():
    steps = []

    class Recorder:
        random = np.random.default_rng(3)

        def step(self, before, target):
            steps.append(Counter(zip(target.tolist(), *before.tolist())))

    words = [language_model.END.encode(), *(f"w{i}".encode() for i in range(70))]
    texts = [" ".join(f"w{(i * j + j) % 70}" for j in range(500 + i)).encode() for i in range(450)] + [None, b""]
    places, kind = language_model.Places(words), language_model.place_type(len(words))
    encoded = [places.of(language_model.tokens(text)).astype(kind).tobytes() for text in texts]
    seen = language_model.train_on(iter(encoded), Recorder(), kind)
    wanted, with_contexts = Counter(), Counter()
    for text in texts:
        at = places.of(language_model.tokens(text)).tolist()
        wanted.update(at)
        padded = [0] * language_model.CONTEXT + at  # contexts end where the text begins
        with_contexts.update(zip(at, *(padded[language_model.CONTEXT - k : len(padded) - k] for k in range(1, language_model.CONTEXT + 1))))
    targets = Counter()
    for step in steps:
        for (target, *_), times in step.items():
            targets[target] += times
    assert seen == sum(wanted.values()) > 2 * language_model.HELD_BATCHES * language_model.BATCH
    assert targets == wanted and all(steps)  # and no empty step; here every word is a class of its own
    assert sum(steps, Counter()) == with_contexts


@pytest.mark.parametrize("words", [1, 96, 97, 98, 105, 106, 1500])
def test_language_model_is_normalised_over_words(words):
    bounds = language_model.group_bounds(words)
    class_at = language_model.classes_of([str(i).encode() for i in range(words)])
    assert bounds[-1] == max(words - 96, 0) and (np.diff(bounds) > 0).all() and len(class_at) == words + language_model.CLASSES
    flat = np.random.default_rng(1).standard_normal(sum(language_model.sizes_of(words))).astype(np.float32)
    model = language_model.Parameters(flat, words)
    assert len(model.R) == words + language_model.CLASSES and len(model.T) == bounds[-1]  # own vectors for every word
    classes_left = [c for c in range(language_model.CLASSES) if c >= min(words, 96)]
    place = np.concatenate([np.arange(words), words + np.array(classes_left)])
    before = np.tile(np.array([[words], [0], [words - 1], [words + 127]]), (1, len(place)))
    total = np.exp(model.word_log_probabilities(before, place, class_at[place])).sum()
    assert abs(total - 1) < 1e-4


def test_shards_do_not_depend_on_partitions(spark, tables, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD", 20_000)
    docs, losses = tables[0].select("doc_id", "text"), {}
    for parts in (1, 4, 32):
        rows = language_model.score_texts(docs.repartition(parts)).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"})
        row = rows.first()
        losses[parts] = -row["sum(score)"] / row["sum(n_tokens)"]
        assert losses[parts] < -row["sum(base_score)"] / row["sum(n_tokens)"]
    assert max(losses.values()) - min(losses.values()) < 0.02, losses


def test_steps_follow_the_gradient_of_the_contrast():
    """One step on a tiny model moves every parameter as the numerical gradient of the contrastive loss says."""
    words, m = 100, language_model
    class_at = m.classes_of([b""] * words)
    bounds = m.group_bounds(words)
    classes = m.CLASSES + len(bounds) - 1
    share = np.full(classes, 1 / classes)
    in_group = np.concatenate([np.full(high - low, 1 / (high - low)) for low, high in zip(bounds[:-1], bounds[1:])])
    random = np.random.default_rng(2)
    start = (random.standard_normal(sum(m.sizes_of(words))) * 0.3).astype(np.float32)
    before, place = random.integers(0, words, (m.CONTEXT, 6)), np.array([3, 97, 98, 99, 97, 110])

    class Recorder(m.Trainer):
        def _move(self, name, gradient, at=None):
            full = np.zeros_like(getattr(self.p, name), dtype=np.float64)
            full[... if at is None else at] = gradient
            self.moved[name] = full

    trainer = Recorder(start, m.Trainer.first_squares(words), share, in_group, class_at)
    trainer.moved = {}
    drawn = np.random.default_rng([11, 0])
    trainer.step(before, place)
    noise = np.minimum(np.searchsorted(np.cumsum(share), drawn.random(m.NOISE)), classes - 1)
    found = np.unique(class_at[place][class_at[place] >= m.CLASSES]) - m.CLASSES
    picked = np.searchsorted(trainer.group_cumulative, found[:, None] + drawn.random((len(found), m.GROUP_NOISE)))
    group_noise = dict(zip(found.tolist(), np.minimum(picked, (bounds[found + 1] - 1)[:, None])))

    def gain(flat):
        p, total = m.Parameters(flat, words), 0.0
        log = lambda x: -np.log1p(np.exp(-x))
        for i, word in enumerate(place):
            h = sum(p.R[before[k, i]] * p.C[k] for k in range(m.CONTEXT))
            score = lambda c: h @ p.Q[c] + p.b[c] - math.log(m.NOISE * share[c])
            total += log(score(class_at[word])) + sum(log(-score(c)) for c in noise)
            group = class_at[word] - m.CLASSES
            if group >= 0:
                inner = lambda w: h @ p.T[w] + p.t[w] - math.log(m.GROUP_NOISE * in_group[w])
                total += log(inner(word - m.WORD_CLASSES)) + sum(log(-inner(w)) for w in group_noise[group])
        return total / len(place)

    got = np.concatenate([trainer.moved[name].ravel() for name in ("R", "C", "Q", "b", "T", "t")])
    exact = start.astype(np.float64)
    probes = np.concatenate([np.flatnonzero(got)[::7], np.flatnonzero(got == 0)[::97]])
    for at in probes:
        up, down = exact.copy(), exact.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert abs((gain(up) - gain(down)) / 2e-5 - got[at]) < 1e-5, at


def test_language_model_tells_words_of_one_ending_apart(spark):
    random = np.random.default_rng(5)
    frequent = [f"f{i}" for i in range(120)]
    ids = [i for i in range(900) if not held(i, 7, 2)]

    def text(*pairs):
        parts = [random.choice(frequent, 60) for _ in range(len(pairs) + 1)]
        return " ".join(" ".join(part) + " " + pair for part, pair in zip(parts, [*pairs, ""]))

    rows = [(i, text(*random.permutation(["left uvwxed", "right mnoped"]))) for i in ids]
    probes = ["left uvwxed", "left mnoped", "right mnoped", "right uvwxed"]
    around = text("{}")
    rows += list(zip([i for i in range(2000) if held(i, 7, 2)], map(around.format, probes)))
    scored = {r["doc_id"]: r["score"] for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b, c, d = (scored[i] for i, _ in rows[-4:])
    assert a - b + c - d > 0.1, (a, b, c, d)  # the words' own frequencies cancel out


def test_language_model_edges(spark):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "A b " * 50_000, 3)], "doc_id long, text string, score int")
    rows = language_model.score_texts(odd).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 100_001]
    assert language_model.score_texts(odd.limit(0)).collect() == []
    only_held = spark.createDataFrame([(i, "a b") for i in range(60) if held(i, 7, 2)], "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"]) for r in language_model.score_texts(only_held).collect()} == {(0, 0)}
