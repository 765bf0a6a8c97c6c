import zlib

import numpy as np

from marketloom.llm import language_model


def test_sums_take_columns_and_scores_far_from_0_are_still_bounded():  # op6
    random = np.random.default_rng(1)
    at, rows = random.integers(0, 7, 500), random.standard_normal((500, language_model.WIDTH)).astype(np.float32)
    expected = np.zeros((7, language_model.WIDTH))
    np.add.at(expected, at, rows.astype(np.float64))
    assert np.array_equal(language_model._sums(at, (column.copy() for column in rows.T), 7), expected.astype(np.float32))
    scores = np.array([[0, 200, -200], [1, 2, 3]], np.float32)
    bounded = np.clip(scores, -80, 80).astype(np.float64)
    found = language_model._normalised(scores.copy(), np.array([1, 0]))
    assert np.allclose(found, bounded[[0, 1], [1, 0]] - np.log(np.exp(bounded).sum(axis=1)))


def test_words_above_the_counted_share_are_looked_up_not_joined(spark):  # op6
    from pyspark.sql import functions as F

    words, counted = [b"\n", b"the"], [b"fox", "für".encode()]
    logs, known = np.log10(np.array([2.0, 5.0] + [1.0] * language_model.CLASSES)), np.array([True, True] + [False] * language_model.CLASSES)
    docs = spark.createDataFrame([(1, "The fox fox für rare rare"), (2, None)], "doc_id long, text string")
    docs = docs.withColumns({"text": F.col("text").cast("binary"), "held_out": F.lit(False)})
    one, empty = language_model.encode(docs, words, logs, known, counted, np.log10([4.0, 3.0])).orderBy("doc_id").collect()
    assert (one["n_tokens"], one["head_known"], one["rare"], one["times"]) == (7, 5, ["rare"], [2])
    assert np.isclose(one["head_log"], np.log10(2 * 5)) and np.isclose(one["counted_log"], np.log10(4 * 4 * 3))
    classes = [len(words) + language_model.WORD_CLASSES + zlib.crc32(end) % language_model.ENDING_CLASSES for end in (b"ox", b"ox", "ür".encode(), b"re", b"re")]
    assert np.frombuffer(one["places"], language_model.place_type(len(words))).tolist() == [1, *classes, 0]
    assert (empty["n_tokens"], empty["rare"], empty["counted_log"]) == (1, [], 0.0)


def test_looked_up_words_change_no_score(spark, monkeypatch):  # op6
    texts = [" ".join(f"w{i * i % 97 % (k + 5)}" for i in range(60 + k)) for k in range(30)] + [None, ""]
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(language_model, "HEAD_SHARE", 40)
    found = []
    for share in (0, 100, 10**9):  # none, some, all of the words outside the dictionary
        monkeypatch.setattr(language_model, "COUNTED_SHARE", share)
        found.append(language_model.score_texts(docs).orderBy("doc_id").toPandas())
    for other in found[1:]:
        assert (found[0][["doc_id", "n_tokens", "n_known"]] == other[["doc_id", "n_tokens", "n_known"]]).all(axis=None)
        assert np.allclose(found[0][["base_score", "score"]], other[["base_score", "score"]], rtol=1e-12)
