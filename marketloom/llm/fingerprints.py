"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its leading bits are zero. Chunking is normalised: more bits are asked for
before the usual length, fewer after it. Where chunks end depends on the last 32 bytes only, so an insertion moves the boundaries around it and no
others. The fingerprint is the set of chunk digests with the chunks' lengths; containment is the length of a set's chunks that
another set holds, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import free_name

WINDOW = 32  # bytes that a 32-bit gear hash remembers
LEAST, USUAL, MOST = 16, 64, 256  # bytes of a chunk
STRICT_BITS, LOOSE_BITS = 8, 4  # leading zero bits that end a chunk before and after the usual length
DIGEST_BYTES = 6
GEAR = np.random.default_rng(64).integers(0, 2**32, 256, np.uint32)
KEY_CHARACTERS = 64  # so much of a text, besides its id, decides its range


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: the sum of GEAR[byte] shifted by its distance, for the last WINDOW bytes."""
    rolled = GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < WINDOW:  # sums over twice as many bytes in each step
        longer = rolled.copy()
        longer[reach:] += rolled[:-reach] << np.uint32(reach)
        rolled, reach = longer, reach * 2
    return rolled


def cuts(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks from ``start``, which must be such an end, to the end of the data."""
    base = max(0, start - WINDOW)
    rolled = gear_hashes(data[base:])
    ends = np.flatnonzero(rolled < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = (rolled[ends] < np.uint32(1 << (32 - STRICT_BITS))).tolist()
    found, at, size = [], start, len(data)
    for end, is_strict in zip((ends + (base + 1)).tolist(), strict):
        while end > at + MOST:
            at += MOST
            found.append(at)
        length = end - at
        if length >= USUAL or is_strict and length >= LEAST:
            at = end
            found.append(at)
    while size - at > MOST:
        at += MOST
        found.append(at)
    if at < size:
        found.append(size)
    return found


def chunk_set(data: bytes, ends: list[int]) -> dict[str, int]:
    """Length by digest."""
    starts = [0, *ends[:-1]]
    return {blake2b(data[a:b], digest_size=DIGEST_BYTES).hexdigest(): b - a for a, b in zip(starts, ends)}


def encoded(chunks: dict[str, int]) -> str:
    return " ".join(f"{digest}:{chunks[digest]}" for digest in sorted(chunks))


def decoded(fingerprint: str) -> dict[str, int]:
    return {digest: int(length) for digest, _, length in (part.partition(":") for part in fingerprint.split())}


def containment(one: dict[str, int], other: dict[str, int]) -> float:
    """Share of the first set, by length, that the second holds. An empty set is contained in an empty one only."""
    total = sum(one.values())
    if not total:
        return float(not other)
    return sum(length for digest, length in one.items() if digest in other) / total


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text as a string; of a null or empty one the empty string."""
    data = as_bytes(text)
    return encoded(chunk_set(data, cuts(data)))


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the beginning of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


class _Printed:
    """A text with its chunks, which an edited text shares up to the edit."""

    __slots__ = ("doc_id", "text", "data", "ends", "chunks")

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text, self.data = doc_id, text or "", as_bytes(text)
        self.ends = cuts(self.data)
        self.chunks = chunk_set(self.data, self.ends)

    def row(self, following: _Printed) -> tuple:
        text = edit(self.text, following.text)
        data = as_bytes(text)
        same = len(as_bytes(text[: len(self.text) - len(self.text) // 4]))
        shared = [end for end in self.ends if end < same]
        ends = shared + (cuts(data, shared[-1]) if shared else cuts(data))
        chunks = chunk_set(data, ends)
        return (
            self.doc_id,
            len(self.text),
            sha256(data).hexdigest(),
            encoded(self.chunks),
            encoded(chunks),
            containment(self.chunks, chunks),
            containment(self.chunks, following.chunks),
        )


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _in_order(docs: DataFrame, partitions: int) -> DataFrame:
    """Documents dealt by ranges of ids and beginnings of texts, each range followed by the first document of the next one, marked as a guest.

    Ranges follow the quantiles of these keys, whatever the spread of the ids: a shuffle of the keys alone finds where each
    begins, which is one row for each on the driver. Only one shuffle moves texts. Documents of one id whose texts begin alike share a range.
    """
    key = F.struct(F.col("doc_id").cast("long").alias("place"), F.left(F.coalesce("text", F.lit("")), F.lit(KEY_CHARACTERS)).alias("beginning"))
    keyed = docs.withColumn("key", key)
    dealt = keyed.select("key").repartitionByRange(partitions, "key.place", "key.beginning")
    heads = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("head")).orderBy("head").collect()
    spark = docs.sparkSession
    kind = "place long, beginning string"
    starts = spark.createDataFrame([([r["head"] for r in heads],)], f"starts array<struct<{kind}>>")
    part = F.greatest(F.size(F.filter("starts", lambda head: head <= F.col("key"))) - 1, F.lit(0))
    placed = keyed.crossJoin(F.broadcast(starts)).withColumn("part", part)
    own = placed.select("part", F.lit(0).alias("guest"), F.col("key.place").alias("place"), "doc_id", "text")
    # The first of a range goes to the range before it, that of the first to the last one.
    first = placed.where(F.element_at("starts", F.col("part") + 1) == F.col("key"))
    visiting = first.groupBy("part").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("doc_id").alias("doc_id"), F.first("key.place").alias("place"))
    visiting = visiting.select(
        F.pmod(F.col("part") - 1, F.lit(max(len(heads), 1))).alias("part"), F.lit(1).alias("guest"), "place", "doc_id", "text"
    )
    return own.unionByName(visiting).repartitionById(partitions, F.col("part")).sortWithinPartitions("part", "guest", "place", "text")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (``edit`` with the next document in order of the numeric ids, after the
    last the first), and how far its chunks are contained in the edited text and in the next document.

    Null texts are empty. Null ids come first; equal ids are in order of their texts. A single document is its own successor. An empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: _Printed | None = None
        visited = False
        for batch in batches:
            rows = []
            ids = [None if pd.isna(x) else x for x in batch["doc_id"]]
            for guest, name, value in zip(batch["guest"].tolist(), ids, batch["text"]):
                if guest and (visited or held is None):
                    continue  # only the first guest follows
                printed = _Printed(name, value)
                if held is not None:
                    rows.append(held.row(printed))
                held, visited = (None, True) if guest else (printed, False)
            yield pd.DataFrame(rows, columns=COLUMNS)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(base, partitions).select("guest", "doc_id", "text").mapInPandas(compare, schema)


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their fingerprints as a last column, under a free name if they have a column ``fingerprint``."""

    @F.pandas_udf("string")
    def printed(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint, na_action=None)

    return docs.withColumn(free_name(docs, "fingerprint"), printed(F.col(text)))
