"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

A test item leaks into a document if at least SIMILARITY of the item's distinct five-word shingles occur in the document.
Documents may be thousands of times longer than an item, so that their Jaccard similarity says nothing. The sketch
is therefore taken of the items alone: the smallest hash values of the item's shingles (bottom-k MinHash). Items are partitioned by
size, in powers of two, and the partition's upper bound fixes k = floor((1 - SIMILARITY) * bound) + 1, one more than the shingles
that a leaked item of the partition can lack. A document that holds the item therefore holds at least one
sketch value, whatever its length: the search misses nothing. What it finds is verified on the texts of the shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import NOT_WORD, SHINGLE_WORDS, SIMILARITY, bound, durable, free_name, row_key, small_side


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingles(word_list: Column, of: Callable[[Column], Column]) -> Column:
    """The shingles of a word list. The list is bound first, or else every shingle would split the text anew."""

    def all_of(known: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(known) - SHINGLE_WORDS + 1)
        starts = F.when(F.size(known) >= SHINGLE_WORDS, starts).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: of(F.slice(known, i, F.lit(SHINGLE_WORDS))))

    return bound(word_list, all_of)


def shingle_hashes(word_list: Column) -> Column:
    return _shingles(word_list, lambda shingle: F.xxhash64(shingle))


def shingle_texts(word_list: Column) -> Column:
    return F.array_distinct(_shingles(word_list, lambda shingle: F.array_join(shingle, " ")))


def item_sketches(items: DataFrame, item_id: str = "item_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(item, hash): the sketch of each item, as large as its size partition asks."""
    hashed = items.select(
        row_key(item_id, text).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(words(F.col(text))))).alias("hashes")
    ).where(F.size("hashes") > 0)
    bound = F.pow(F.lit(2.0), F.floor(F.log2(F.size("hashes"))) + 1) - 1  # largest size of the partition
    k = (F.floor(F.lit(1 - similarity + 1e-9) * bound) + 1).cast("int")
    return hashed.select("item", F.explode(F.slice("hashes", F.lit(1), k)).alias("hash")).distinct()


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_key, doc_id, item_id, item_shingles, shared, containment.

    Null or empty texts and items of fewer than five words have no shingle and match nothing. Repeated rows give one pair.
    Rows without id are told apart by their texts. No documents or no items give no pairs.
    Only the counted sketches and candidate keys are ever broadcast, and shuffled beyond the bound.
    """
    base = docs.select(row_key(doc_id, text).alias("doc_key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = small_side(durable(item_sketches(items, item_id, item_text, similarity)))
    hashed = base.select("doc_key", F.explode(shingle_hashes(words(F.col("text")))).alias("hash"))
    candidates = durable(hashed.join(sketches, "hash").select("doc_key", "item").distinct())

    held = small_side(durable(candidates.select("doc_key").distinct()))
    found = base.join(held, "doc_key", "left_semi").dropDuplicates(["doc_key"])
    found = found.select("doc_key", "doc_id", shingle_texts(words(F.col("text"))).alias("doc_shingles"))
    wanted = items.select(
        row_key(item_id, item_text).alias("item"),
        F.col(item_id).alias("item_id"),
        shingle_texts(words(F.col(item_text))).alias("wanted"),
    ).dropDuplicates(["item"])
    pairs = candidates.join(wanted, "item").join(found, "doc_key")
    counted = pairs.select(
        "doc_key",
        "doc_id",
        "item_id",
        F.size("wanted").cast("long").alias("item_shingles"),
        F.size(F.array_intersect("wanted", "doc_shingles")).cast("long").alias("shared"),
    )
    rated = counted.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    return rated.where(F.col("containment") >= similarity)


def remove_leaks(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; repeated clean rows stay."""
    leaks = small_side(durable(find_leaks(docs, items, **columns).select("doc_key").distinct()))
    key = free_name(docs, "doc_key")
    keyed = docs.withColumn(key, row_key(columns.get("doc_id", "doc_id"), columns.get("text", "text")))
    return keyed.join(leaks.withColumnRenamed("doc_key", key), key, "left_anti").drop(key)


ORACLE_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s
  FROM d WHERE len(w) >= 5),
its AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s
  FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared / item_shingles >= 0.8
"""
