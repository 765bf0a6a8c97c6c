"""Target-distribution importance resampling: hashed n-gram features, log-ratio gains, Gumbel keys.

Features are found by batch concatenation: the texts of a batch are joined by a byte that no word holds, one regex pass
finds all words, and their starts, searched in the sorted offsets of the documents, tell which neighbours belong to one text. The CRC of
two words joined by a space follows from the CRCs of the words by table look-ups, so that buckets of all
features come out as one array, counted by bincount. Corpus and target counts cover all texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import free_name, written

BUCKETS = 10_000
LEAST_WORDS = 20  # a document of fewer words is never drawn
DRAWN_PERCENT = 25
SEED = "7"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTINEL = b"\x00"  # between texts; no word holds it
BATCH_BYTES = 4_000_000  # texts joined at once; a longer text is a batch of its own
WINDOW_BYTES = 500_000  # bytes whose words are held at once
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
IN_WORD = np.array([not BREAK.match(bytes([value])) for value in range(256)], np.int8)
ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def _byte_table() -> np.ndarray:
    """CRC-32 of single bytes without the inversions around it, which make it affine instead of linear."""
    zero = crc32(b"\0")
    return np.array([crc32(bytes([value])) ^ zero for value in range(256)], np.uint32)


class CrcJoin:
    """CRCs of joined words from the words' CRCs and lengths. For zero bytes appended to the left word the CRC register moves
    by a linear map; the maps for 1, 2, 4, ... bytes are tables over the register's four bytes."""

    def __init__(self):
        self.table = _byte_table()
        registers = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
        self.maps = [self._step(registers)]

    def _step(self, register: np.ndarray) -> np.ndarray:
        return self.table[register & np.uint32(255)] ^ (register >> np.uint32(8))

    @staticmethod
    def _moved(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
        moved = tables[0][register & np.uint32(255)]
        for byte in (1, 2, 3):
            moved = moved ^ tables[byte][(register >> np.uint32(8 * byte)) & np.uint32(255)]
        return moved

    def joined(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRCs of left + space + right; ``length`` is that of the right words in bytes."""
        ones = np.uint32(0xFFFFFFFF)
        register = self._step(left ^ ones ^ np.uint32(0x20)) ^ ones
        for bit in range(int(length.max(initial=0)).bit_length()):
            if bit == len(self.maps):
                self.maps.append(self._moved(self.maps[-1], self.maps[-1]))
            at = np.flatnonzero((length >> bit) & 1)
            register[at] = self._moved(self.maps[bit], register[at])
        return register ^ right


def text_batches(texts: Iterator[bytes | None]) -> Iterator[list[bytes]]:
    """Texts in lists of about BATCH_BYTES; null is an empty text."""
    batch, size = [], 0
    for text in texts:
        batch.append(text or b"")
        size += len(batch[-1]) + 1
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def windows(joined: bytes) -> Iterator[tuple[int, int]]:
    """Cuts of about WINDOW_BYTES, never inside a word."""
    start = 0
    while start < len(joined):
        edge = BREAK.search(joined, min(start + WINDOW_BYTES, len(joined)))
        end = edge.start() if edge else len(joined)
        yield start, end
        start = end


def features(texts: list[bytes], join: CrcJoin) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document, bucket, words) of the features of joined texts, window by window: first the single words, ``words`` of them,
    then the pairs."""
    offsets = np.cumsum([0, *(len(text) + 1 for text in texts[:-1])])
    joined = SENTINEL.join(texts).lower()  # of bytes, only A-Z get lower
    last_doc, last_crc = np.full(1, -1), np.zeros(1, np.uint32)
    for start, end in windows(joined):
        words = WORDS.findall(joined, start, end)
        if not words:
            continue
        inside = np.zeros(end - start + 1, np.int8)
        inside[1:] = IN_WORD[np.frombuffer(joined, np.uint8, end - start, start)]
        starts = start + np.flatnonzero(inside[1:] > inside[:-1])
        length = np.fromiter(map(len, words), np.int64, len(words))
        crc = np.fromiter(map(crc32, words), np.uint32, len(words))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        same = np.concatenate([last_doc, doc[:-1]]) == doc
        pairs = join.joined(np.concatenate([last_crc, crc[:-1]])[same], crc[same], length[same])
        yield np.concatenate([doc, doc[same]]), np.concatenate([crc, pairs]) % np.uint32(BUCKETS), len(crc)
        last_doc, last_crc = doc[-1:], crc[-1:]


def bucket_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Features of all texts by bucket. Each task sends at most one row per bucket, the driver gets BUCKETS rows at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        join, total = CrcJoin(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in text_batches(iter(batch["text"])):
                for _, bucket, _ in features(texts, join):
                    total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "found": total[used]})

    raw = docs.select(F.col(text).cast("binary").alias("text"))
    counted = raw.mapInPandas(count, "bucket long, found long").groupBy("bucket").agg(F.sum("found"))
    return dict(map(tuple, counted.collect()))


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to that in the corpus, each smoothed by one."""
    in_corpus, in_target = sum(corpus.values()), sum(target.values())
    return np.array(
        [
            math.floor(
                1000
                * math.log(
                    float((target.get(bucket, 0) + 1) * (in_corpus + BUCKETS))
                    / float((corpus.get(bucket, 0) + 1) * (in_target + BUCKETS))
                )
            )
            for bucket in range(BUCKETS)
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> Column:
    """A struct of n_words, n_features and weight (the floored mean of the gains, 0 without features) of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        join, by_bucket = CrcJoin(), shared.value
        for batch in batches:
            parts = []
            for texts in text_batches(iter(batch)):
                size = len(texts)
                counts = np.zeros((3, size), np.int64)
                for doc, bucket, words in features(texts, join):
                    counts[0] += np.bincount(doc[:words], minlength=size)
                    counts[1] += np.bincount(doc, minlength=size)
                    counts[2] += np.bincount(doc, by_bucket[bucket], minlength=size).astype(np.int64)
                parts.append(counts)
            words, found, total = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
            yield pd.DataFrame({"n_words": words, "n_features": found, "weight": total // np.maximum(found, 1)})

    return weigh(F.col(text).cast("binary"))


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel draw in thousandths, fixed by the id; a null id counts as empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform))).cast("long")


def positions(stored: DataFrame, order: list[Column]) -> DataFrame:
    """Adds position (from 1) in an order that no two rows share, so that equal scores split over tasks. Ranges are sorted and stored;
    a row's position is its place in its range after the sizes of the ranges before, of which there is one row per task."""
    ranged = stored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", F.monotonically_increasing_id())
    ranged = written(ranged).withColumn("range", F.shiftright("slot", ROW_BITS))
    sizes = dict(map(tuple, ranged.groupBy("range").agg(F.count(F.lit(1))).collect()))
    starts, before = {}, 0
    for number in sorted(sizes):
        starts[number], before = before, before + sizes[number]
    if not starts:
        return ranged.withColumn("position", F.lit(None).cast("long")).drop("range", "slot")
    table = stored.sparkSession.createDataFrame(list(starts.items()), "range long, before long")  # a row per task
    row = F.col("slot").bitwiseAND((1 << ROW_BITS) - 1)
    return ranged.join(F.broadcast(table), "range").withColumn("position", F.col("before") + row + 1).drop("range", "slot", "before")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight, score, rank) of every document. Of the N documents with at least LEAST_WORDS words,
    the DRAWN_PERCENT percent with the highest scores (weight plus Gumbel draw) are drawn and ranked from 1; equal scores go by smaller id,
    null ids first, then by position in the stored table. ``text_key`` is a hash of the text.

    Null and empty texts have no features and weight 0. Repeated rows are rows of their own, so each takes part. An empty target leaves
    the smoothing alone; an empty corpus gives no rows. Other columns are left out; ``drawn`` brings them back.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = docs.select(F.col(doc_id).alias("doc_id"), key.alias("text_key"), weighed(docs, gain, text).alias("found"))
    scored = found.select("doc_id", "text_key", "found.*").withColumn("score", F.col("weight") + gumbel(F.col("doc_id")))
    stored = written(scored.withColumn("place", F.monotonically_increasing_id()))
    fits = F.col("n_words") >= LEAST_WORDS
    draws = stored.where(fits).count() * DRAWN_PERCENT // 100
    order = [fits.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("place").asc()]
    placed = positions(stored, order)
    rank = F.when(F.col("position") <= draws, F.col("position")).alias("rank")
    return placed.select("doc_id", "text_key", "n_words", "n_features", "weight", "score", rank)


def drawn(docs: DataFrame, resampled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn documents with all their columns; rows that agree in id and text come together if one of them is drawn."""
    identity, key = free_name(docs, "drawn_id"), free_name(docs, "drawn_key")
    taken = resampled.where(F.col("rank").isNotNull())
    taken = taken.select(F.col("doc_id").alias(identity), F.col("text_key").alias(key)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(identity)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(key))
    return docs.join(taken, same, "left_semi")
