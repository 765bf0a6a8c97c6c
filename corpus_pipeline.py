"""The corpus pipeline: toxicity, quality, near duplicates, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns the columns of
``docs``, whatever other columns these have; the last one adds the number of the copy. Nulls are allowed in any column, a null text counts as
empty, and an empty table stays empty. Each result is written as Parquet, in the folder of
spark.checkpoint.dir, and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import decontamination, mixing, near_join, quality, toxicity
from marketloom.llm.common import ensure_checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not graded as toxic. An empty text has no marker words and stays; repeated rows share their fate."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by their text alone. All empty texts have one score, so they stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies. Texts without words are one class, rows that repeat id and text are one document."""
    return near_join.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row by its own text; texts of fewer than five words hold none."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to several times; a null source is a source, one without any words gives nothing."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # trained scores have no SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of the documents table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
