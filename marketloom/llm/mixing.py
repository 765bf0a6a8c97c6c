"""Mixing sources to target weights: whole repetitions plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.common import durable, free_name, small_side

WORD = r"[^\x20\x09-\x0D]+"  # a word for the size of a text: no ASCII white space
WEIGHTS = (1, 2, 3)  # weights of the sources in order of their names, repeating
MOST_REPEATS = 3  # a source is stretched to at most so many times its size
SEED = "mix-1"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that equals itself for a missing source, too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from seed and document, the same in every run: 52 bits of a digest of the id, or of
    the text where the id is missing."""
    name = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**52)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size, target) from rows (source, size).

    Targets share the sum of all sizes by weight and stop at MOST_REPEATS times the source's size; the excess goes to
    the others by weight. With sources in order of cap / weight, all before some point are capped, and the
    water level there is (total - caps before) / (weights from there on). The windows see one row for
    each source, never documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(by_name) - 1, len(WEIGHTS)) + 1)
    weighed = sources.select(
        source_key(F.col("source")).alias("source_key"),
        "source_size",
        weight.alias("weight"),
        (F.col("source_size") * MOST_REPEATS).alias("cap"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before, after = Window.unboundedPreceding, Window.unboundedFollowing
    whole = Window.rowsBetween(before, after)
    levels = weighed.select(
        "*",
        F.row_number().over(by_ratio).alias("place"),
        (
            (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(before, -1)), F.lit(0)))
            / F.sum("weight").over(by_ratio.rowsBetween(0, after))
        ).alias("level"),
    )
    below = F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("place"))
    level = F.min_by("level", below).over(whole)
    return levels.select("source_key", "source_size", "weight", "cap", level.alias("level")).select(
        "source_key", "source_size", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")).alias("target")
    )


def mixing_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: bool = False) -> DataFrame:
    """How often the mix takes each document: one row per document with doc_id, size, source_size, target,
    copies and taken (size times copies); with ``keep``, all columns of the documents and ``copies`` under a free name (the last column).

    A source of rate target / size takes every document floor(rate) times and once more if the document's draw is
    below the fraction. Null texts have size 0; a null source is a source of its own, last in order; a source of only empty
    texts has target 0 and takes nothing. Repeated rows are decided alike. An empty table gives no rows.
    Documents join their source's row by broadcast while there are few sources, else by a shuffle
    whose hot sources the skewed join splits.
    """
    sizes = docs.select(F.col(source).alias("source"), text_size(F.col(text)).alias("size"))
    targets = small_side(durable(source_targets(sizes)))
    key = free_name(docs, "source_key")
    targets = targets.withColumnsRenamed({"source_key": key, "source_size": "mix_source_size", "target": "mix_target"})
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    if keep:
        names = {f"c{i}": name for i, name in enumerate(docs.columns)}
        inner = docs.toDF(*names)
        at = {name: short for short, name in names.items()}
        base = inner.withColumns({key: source_key(F.col(at[source])), "mix_draw": draw(F.col(at[doc_id]), F.col(at[text]))})
    else:
        base = docs.select(
            F.col(doc_id).alias("doc_id"),
            source_key(F.col(source)).alias(key),
            text_size(F.col(text)).alias("size"),
            draw(F.col(doc_id), F.col(text)).alias("mix_draw"),
        )
    more = F.when(F.col("mix_draw") < rate - F.floor(rate), 1).otherwise(0)
    planned = base.join(targets, key).withColumn("copies", (F.floor(rate) + more).cast("int"))
    if keep:
        return planned.select(*[F.col(s).alias(n) for s, n in names.items()], F.col("copies").alias(free_name(docs, "copies")))
    return planned.select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each document as often as ``mixing_plan`` says, with its columns and the number of the copy."""
    planned = mixing_plan(docs, doc_id, text, source, keep=True)
    copies = planned.columns[-1]
    number = free_name(docs, "copy")
    taken = planned.where(F.col(copies) > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(number))


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER w AS place,
    ((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, coalesce('s' || source, '-'))),
chosen AS (
  SELECT level FROM levels WHERE cap >= weight * level ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * (SELECT level FROM chosen), cap::DOUBLE) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, md5(d.text), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
