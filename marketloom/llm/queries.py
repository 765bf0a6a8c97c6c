"""The registered queries of the text operators, over the whole benchmark tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import (
    chat,
    decontamination,
    fingerprints,
    html_text,
    language_model,
    mixing,
    near_join,
    quality,
    resampling,
    token_counts,
    toxicity,
    url_filter,
    whitening,
)
from marketloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), "predicted")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, folder, "labels")).drop("text")


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, folder, "documents"))


def op4_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    leaks = decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.drop("doc_key")


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


def op6_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_join.near_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", "class_id", "n_links", "n_shingles")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def op10_chat_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return chat.linked_messages(table(spark, folder, "conversations"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.component_rows(table(spark, folder, "embeddings"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_toxicity": op2_toxicity,
    "op3_source_mixing": op3_source_mixing,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_fingerprints": op5_fingerprints,
    "op6_lm_scores": op6_lm_scores,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_url_filter": op8_url_filter,
    "op9_html_text": op9_html_text,
    "op10_chat_quotes": op10_chat_quotes,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {
    "op3_source_mixing": mixing.ORACLE_SQL,
    "op4_benchmark_leaks": decontamination.ORACLE_SQL,
    "op7_ngram_jaccard_join": near_join.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_chat_quotes": chat.ORACLE_SQL,
}
