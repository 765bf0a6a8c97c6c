"""N-gram Jaccard join by MinHash banding.

1. Every text becomes a set of five-word shingles; texts with the same set count as one from here on.
2. Each set gets a MinHash signature, cut into bands; sets that agree in a band meet in a bucket (a shuffle on band hashes).
   Band and row counts follow from the similarity and the recall wanted.
3. In a bucket, pairs whose signatures are far from the threshold go; what remains only says which sets belong to one
   candidate group, so a bucket emits one edge for each member and never its pairs.
4. The full sets of each candidate group meet and their pairs are verified exactly, by matrix products. A large group is cut into
   blocks in the order of set sizes, and a set goes only to those pairs of blocks that hold sizes it can be similar to. A pair of
   blocks emits counts of links and one edge for each member.
5. Links are counted with the copies of either set, classes are the components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import (
    FIND_WORDS,
    SHINGLE_WORDS,
    SIMILARITY,
    durable,
    free_name,
    small_side,
    sparse_hash,
)
from marketloom.llm.components import connected_components

RECALL = 0.9999  # of pairs at the threshold; pairs above it are found still more surely
MOST_HASHES = 128  # hash functions of a signature at most
BUCKET_BLOCK = 256  # members of a bucket that one comparison takes; larger buckets are cut into pairs of blocks
GROUP_ROWS, GROUP_SHINGLES = 1024, 1 << 21  # rows and shingles that a block of a candidate group holds at most, about
LOG_STEPS = 10**9  # steps in which logarithms of sizes are compared
SLACK_DEVIATIONS = 6  # a signature may understate the similarity by so many standard deviations
CACHED_WORDS = 1_000_000
ROUNDING = 1 - 1e-12  # a pair exactly at the threshold counts however its products are rounded


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as possible, hence as few false candidates, such that a pair at the threshold
    meets with the wanted probability, 1 - (1 - similarity ** rows) ** bands, within ``most`` hash functions."""
    best = (most, 1)
    for rows in range(1, most + 1):
        chance = similarity**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. A text of fewer than five words is one shingle; none has no words."""
    words = FIND_WORDS((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = sparse_hash(rolled) + values[k : len(values) - width + 1 + k]
    return np.unique(sparse_hash(rolled))


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return random.integers(1, 2**32, count, np.uint32) | np.uint32(1), random.integers(0, 2**32, count, np.uint32)


def minhash(values: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    factors, shifts = family
    low = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        part = low[start : start + 2048, None] * factors
        part += shifts
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """One row per document: doc_id, text_key, digest of its shingle set, n (its size), bands, signature."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _text_key(text).alias("text_key"))
    kind = dict(source.dtypes)["doc_id"]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, family = WordHashes(), _hash_family(bands * rows)
        weights = sparse_hash(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            sets = [shingle_set(value, hashes) for value in batch["text"]]
            least = np.array([minhash(s, family) for s in sets], np.uint32).reshape(len(sets), bands * rows)
            mixed = (least.reshape(-1, bands, rows).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
            mixed = sparse_hash(sparse_hash(mixed + np.arange(bands, dtype=np.uint64))).view(np.int64)
            marks = (least & np.uint32(0xFF)).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_key": batch["text_key"],
                    "digest": [blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets],
                    "n": np.array([len(s) for s in sets], np.int64),
                    "bands": [row if len(s) else row[:0] for row, s in zip(mixed, sets)],
                    "signature": [row.tobytes() for row in marks],
                }
            )

    schema = f"doc_id {kind}, text_key long, digest string, n long, bands array<long>, signature binary"
    return source.mapInPandas(sketch, schema)


def _text_key(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that end where a group of the sorted rows ends. A group is as large as a block at most."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        if held and tuple(held[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[-1]):
            changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            changed[0] = tuple(held[-1][keys].iloc[-1]) != tuple(batch[keys].iloc[0])
            last = int(np.flatnonzero(changed)[-1])
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = [batch.iloc[last:]]
        elif held:
            held.append(batch)
        else:
            changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            last = int(np.flatnonzero(changed)[-1])
            if last:
                yield batch.iloc[:last].reset_index(drop=True)
            held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _smallest_reachable(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` nodes, the smallest node reachable over the edges."""
    label = np.arange(count)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def bucket_edges(batches: Iterator[pd.DataFrame], similarity: float, hashes: int) -> Iterator[pd.DataFrame]:
    """Edges between sets that share a bucket and whose signatures allow the similarity: one for each set at most."""
    slack = similarity - SLACK_DEVIATIONS * math.sqrt(similarity * (1 - similarity) / hashes)
    for frame in _whole_groups(batches, ["bucket", "low", "high"]):
        group = (frame[["bucket", "low", "high"]] != frame[["bucket", "low", "high"]].shift()).any(axis=1).cumsum().to_numpy()
        cross = (frame["low"] != frame["high"]).to_numpy()
        block, size = frame["block"].to_numpy(), frame["n"].to_numpy()
        ids, node = np.unique(frame["uid"].to_numpy(), return_inverse=True)
        marks = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(len(frame), hashes)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(1, len(frame)):
            i = np.flatnonzero(group[:-step] == group[step:])
            if not len(i):
                break
            j = i + step
            fits = ~(cross[i] & (block[i] == block[j]))
            fits &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) * ROUNDING
            i, j = i[fits], j[fits]
            near = (marks[i] == marks[j]).mean(axis=1) >= slack
            found.append((node[i[near]], node[j[near]]))
        left = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
        right = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
        label = _smallest_reachable(len(ids), left, right)
        linked = np.flatnonzero(label != np.arange(len(ids)))
        yield pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})


def verified(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """All pairs of one block of a candidate group, compared on their full sets: uid, links (copies of the linked
    sets), label (smallest uid reachable over the links found here)."""
    frame = frame.drop_duplicates("uid").sort_values("uid", ignore_index=True)
    sets = [np.frombuffer(value, np.uint64) for value in frame["shingles"]]
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
    shared = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    owner, (_, column) = owner[shared], np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inner = frame["low"].iloc[0] == frame["high"].iloc[0]
    one, two = (np.flatnonzero(frame["block"] == frame[side]) for side in ("low", "high"))
    common = np.zeros((len(one), len(two)))
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[low:high], column[low:high] - start] = 1
        common += dense[one] @ dense[two].T  # whole numbers up to the width, exact in both
    linked = common * (1 + similarity) >= similarity * (size[one, None] + size[None, two]) * ROUNDING
    if inner:
        np.fill_diagonal(linked, False)
    left, right = np.nonzero(linked)
    label = _smallest_reachable(len(sets), one[left], two[right])
    uid, copies = frame["uid"].to_numpy(), frame["copies"].to_numpy(np.int64)
    links = np.zeros(len(sets), np.int64)
    links[one] = linked @ copies[two]
    if not inner:
        links[two] = copies[one] @ linked
    return pd.DataFrame({"uid": uid, "links": links, "label": uid[label]})


def _in_blocks(frame: DataFrame, count: str) -> DataFrame:
    """Each row once for every pair of blocks (low, high) that its own block, by hash of uid, takes part in."""
    own = F.pmod(F.xxhash64("uid"), F.col(count))
    spread = frame.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    return spread.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", count)


def _in_size_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """Adds block, first_met and last_met to the members (uid, component, n) of candidate groups.

    Blocks number the sets of a group in the order of n, as many as the group's rows and shingles ask for; sets of one size are dealt
    by hash of uid. A set of n shingles can only be similar to sets of similarity * n to n / similarity shingles, and these lie in the blocks
    first_met to last_met. The windows see one row for each size in a group, however many sets have it.
    """
    weight = F.greatest(F.col("n"), F.lit(GROUP_SHINGLES // GROUP_ROWS).cast("long"))
    group = Window.partitionBy("component")
    ordered = group.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = members.groupBy("component", "n").agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"))
    placed = sizes.select(
        "*", F.sum("weight").over(group).alias("total"), F.coalesce(F.sum("weight").over(ordered), F.lit(0)).alias("before")
    )

    def block_at(place):
        blocks = F.ceil(F.col("total") / GROUP_SHINGLES)
        return F.least(F.floor(place / F.col("total") * blocks), blocks - 1)

    each = F.col("weight") / F.col("rows")
    near = group.orderBy(F.floor(F.log("n") * LOG_STEPS))  # a frame of sizes by their ratio
    apart = math.ceil(-math.log(similarity) * LOG_STEPS) + 1
    met = placed.select(
        "component",
        "n",
        "rows",
        "total",
        "before",
        each.alias("each"),
        F.min(block_at(F.col("before"))).over(near.rangeBetween(-apart, 0)).alias("first_met"),
        F.max(block_at(F.col("before") + each * (F.col("rows") - 1))).over(near.rangeBetween(0, apart)).alias("last_met"),
    )
    own = block_at(F.col("before") + F.col("each") * F.pmod(F.xxhash64("uid"), F.col("rows")))
    return members.join(met, ["component", "n"]).withColumn("block", own).drop("rows", "total", "before", "each")


def _in_pairs(frame: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks (low, high) that its own block takes part in."""
    spread = frame.withColumn("other", F.explode(F.sequence("first_met", "last_met"))).drop("first_met", "last_met")
    return spread.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, n_links, n_shingles, keeper.

    A link joins two documents whose shingle sets have a Jaccard similarity of at least ``similarity``; n_links counts the other
    documents linked to this one, exact copies included. A class is a connected component of links, class_id its
    smallest doc_id; ``keeper`` is the row key (id and text) of the one document to keep: the smallest id, null ids last.

    Null texts are empty. Texts without words have equal, empty sets and form one class. Repeated rows are copies
    of one another. A class of only null ids has a null class_id. An empty table gives no rows.
    """
    bands, rows = choose_bands(similarity, recall)
    hashes = bands * rows
    rough = durable(sketches(docs, doc_id, text, bands, rows))
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    sets = durable(
        rough.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(first).alias("first"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        )
        .withColumn("uid", F.monotonically_increasing_id())
    )

    keyed = sets.select("uid", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = keyed.join(shared, "bucket").join(sets.select("uid", "n", "signature"), "uid")
    members = members.withColumn("blocks", F.ceil(F.col("members") / BUCKET_BLOCK)).drop("members")
    keys = ["bucket", "low", "high"]
    buckets = _in_blocks(members, "blocks").repartition(_partitions(docs), *keys).sortWithinPartitions(*keys)
    edges = buckets.mapInPandas(lambda batches: bucket_edges(batches, similarity, hashes), "a long, b long")
    groups = connected_components(edges)

    members = groups.withColumnRenamed("node", "uid").join(sets.select("uid", "n", "copies", "first"), "uid")
    wanted = durable(
        _in_size_blocks(members, similarity).select(
            "uid",
            "component",
            "block",
            "first_met",
            "last_met",
            "copies",
            F.col("first.doc_id").alias("first_id"),
            F.col("first.text_key").alias("first_key"),
        )
    )
    texts = docs.select(F.col(doc_id).alias("first_id"), F.col(text).alias("text"), _text_key(text).alias("first_key"))
    side = small_side(wanted).alias("w")
    same = (F.col("t.first_key") == F.col("w.first_key")) & F.col("t.first_id").eqNullSafe(F.col("w.first_id"))
    chosen = texts.alias("t").join(side, same).select(*[f"w.{name}" for name in ("uid", "component", "block", "first_met", "last_met", "copies")], "t.text")
    chosen = chosen.dropDuplicates(["uid"])

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            batch["shingles"] = [shingle_set(value, words).tobytes() for value in batch.pop("text")]
            yield batch

    schema = "uid long, component long, block long, first_met long, last_met long, copies long, shingles binary"
    filled = chosen.mapInPandas(with_sets, schema)
    keys = ["component", "low", "high"]
    blocked = _in_pairs(filled).repartition(_partitions(docs), *keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, keys):
            for _, group in frame.groupby(keys, sort=False):
                yield verified(group, similarity)

    checked = durable(blocked.mapInPandas(verify, "uid long, links long, label long"))
    links = checked.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.where("uid <> label"), "uid", "label")

    placed = (
        sets.select("uid", "digest", "copies", "first")
        .join(links, "uid", "left")
        .join(classes.withColumnRenamed("node", "uid"), "uid", "left")
        .withColumn("component", F.coalesce("component", "uid"))
    )
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    by_set = placed.join(heads, "component").select(
        "digest",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.col("head.doc_id").alias("class_id"),
        F.concat_ws(":", F.coalesce(F.col("head.doc_id").cast("string"), F.lit("-")), F.col("head.text_key")).alias("keeper"),
    )
    return rough.select("doc_id", "text_key", "digest", "n").join(durable(by_set), "digest").select(
        "doc_id", "text_key", "class_id", "n_links", F.col("n").alias("n_shingles"), "keeper"
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document of each class that ``keeper`` names, with all its columns. Of rows with equal id and text one stays, that
    with the smallest hash of its other columns (maps and variants left out), so that reruns keep the same one."""
    key = free_name(docs, "row_key")
    own = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), _text_key(text))
    keepers = near_classes(docs, doc_id, text, **options).select(F.col("keeper").alias(key)).distinct()
    hashed = [f"`{name}`" for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    first = docs.groupBy(own.alias(key)).agg(F.min_by(row, F.xxhash64(*hashed)).alias("row"))
    return first.join(keepers, key, "left_semi").select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b
  WHERE p.common >= 0.8 * (len(x.g) + len(y.g) - p.common)
  UNION ALL SELECT x.doc_id, y.doc_id FROM s x JOIN s y ON x.doc_id <> y.doc_id WHERE len(x.g) = 0 AND len(y.g) = 0),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, (SELECT min(r.b) FROM reach r WHERE r.a = s.doc_id) AS class_id,
  (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links, len(s.g)::BIGINT AS n_shingles
FROM s
"""
