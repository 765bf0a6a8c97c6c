"""Importance resampling against a plain version of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from marketloom.llm import queries, resampling

FOLDER = "/root/testdata/sf0.001"
LOWER = {code: code + 32 for code in range(65, 91)}


def feature_buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    both = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(feature.encode()) % 10_000 for feature in both]


def plain(docs, targets):
    """doc rows (id, text) -> list of (id, n_features, weight, score, rank)."""
    found = [feature_buckets(text) for _, text in docs]
    corpus = Counter(bucket for _, buckets in found for bucket in buckets)
    target = Counter(bucket for text in targets for bucket in feature_buckets(text)[1])
    in_corpus, in_target = sum(corpus.values()), sum(target.values())

    def gain(b):
        return math.floor(1000 * math.log(((target[b] + 1) * (in_corpus + 10_000)) / ((corpus[b] + 1) * (in_target + 10_000))))

    rows = []
    for (doc_id, _), (words, buckets) in zip(docs, found):
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        rows.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((row for row in rows if row[4] >= 20), key=lambda row: (-row[3], -1 if row[0] is None else row[0]))
    for rank, row in enumerate(fit, 1):
        row.append(rank if rank <= len(fit) * 25 // 100 else None)
    return [(*row[:4], row[5] if len(row) > 5 else None) for row in rows]


def collected(frame):
    return [tuple(row) for row in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def key(row):
    return tuple((value is not None, value or 0) for value in row)


def test_query_against_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = collected(queries.QUERIES["op12_importance_resampling"](spark, FOLDER))
    assert sorted(got, key=key) == sorted(plain(docs, targets), key=key)
    assert any(row[4] for row in got)


def test_features_across_windows_and_documents(monkeypatch):
    monkeypatch.setattr(resampling, "WINDOW_BYTES", 7)
    texts = ["", "One two", "three", "x" * 300 + " Ünï 中文 a1", "\x00a\x00b", "  ", "end"]
    found = [[] for _ in texts]
    for doc, bucket, _ in resampling.features([text.encode() for text in texts], resampling.CrcJoin()):
        for at, value in zip(doc, bucket):
            found[at].append(int(value))
    assert [sorted(part) for part in found] == [sorted(feature_buckets(text)[1]) for text in texts]


def test_joined_crc_for_all_lengths():
    words = [bytes([97 + k % 26]) * k for k in (*range(1, 40), 1000, 70_000)]
    left = np.array([zlib.crc32(b"left")] * len(words), np.uint32)
    right = np.array([zlib.crc32(word) for word in words], np.uint32)
    got = resampling.CrcJoin().joined(left, right, np.array([len(word) for word in words]))
    assert got.tolist() == [zlib.crc32(b"left " + word) for word in words]


def test_edges(spark):
    long_text = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (None, "a b c " * 10), (None, "a b c " * 10), (3, "tie " * 25), (3, "tie " * 25), (4, long_text)]
    rows += [(k, f"some words {k} " * 8) for k in range(5, 40)]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, score string")
    target = spark.createDataFrame([("tie tie",), (None,)], "text string")
    result = resampling.resample(docs, target)
    assert sorted(collected(result), key=key) == sorted(plain(rows, ["tie tie", None]), key=key)
    taken = resampling.drawn(docs, result)
    assert taken.columns == docs.columns
    wanted = {(row.doc_id, row.text_key) for row in result.where("rank is not null").collect()}
    assert len({(row.doc_id, row.text) for row in taken.collect()}) == len(wanted)
    empty = docs.limit(0)
    assert resampling.resample(empty, target).collect() == []
    assert len(resampling.resample(docs, target.limit(0)).collect()) == len(rows)


def test_a_third_of_the_rows_alike_get_ranks_of_their_own(spark):
    rows = [(None, "same words again " * 10)] * 200 + [(k, f"other words {k} " * 10) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collected(resampling.resample(docs, spark.createDataFrame([("same words",)], "text string")))
    assert sorted(row[4] for row in got if row[4]) == list(range(1, 101))
    assert sorted(got, key=key) == sorted(plain(rows, ["same words"]), key=key)
