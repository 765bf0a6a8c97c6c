"""Sinks: raw CSV, Parquet or CSV tables, SQL catalog."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marketloom.operators.headers import LANDING_ORDER
from marketloom.sources.readers import read_bucketed, read_table


def write_raw(df: DataFrame, dataset: str, folder: str, by_stock: bool = False) -> str:
    """A raw feed as CSV with a header; ``by_stock`` gives each stock its own folder."""
    path = f"{folder}/{dataset}.csv"
    writer = df.drop(LANDING_ORDER).write.mode("overwrite").option("header", True).option("escape", '"')
    if by_stock:
        writer = writer.partitionBy("stock_id")
    writer.csv(path)
    return path


def write_table(
    df: DataFrame,
    name: str,
    folder: str,
    file_format: str = "parquet",
    partition: str | None = None,
    sort: Sequence[str] = (),
) -> str:
    """A silver or gold table.

    A partition column goes through a rebalance: adaptive execution splits a large partition value
    over several tasks and merges small ones, so neither huge nor tiny files appear.
    """
    path = f"{folder}/{name}.{file_format}"
    if partition:
        df = df.hint("rebalance", partition)
    if sort:
        df = df.sortWithinPartitions(*([partition] if partition else []), *sort)
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(file_format).save(path)
    return path


def write_bucketed(
    df: DataFrame, name: str, folder: str, buckets: int, key: str = "stock_id", sort: Sequence[str] = ()
) -> DataFrame:
    """A table in ``buckets`` files by hash of the key, each sorted by the key and ``sort``, and the frame that reads it. Joins,
    aggregates and windows by the key, or by keys that include it, then need no exchange."""
    path = f"{folder}/{name}.parquet"
    stage = f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key)
    writer.sortBy(*dict.fromkeys([key, *sort])).option("path", path).saveAsTable(stage)
    df.sparkSession.sql(f"DROP TABLE {stage}")  # the files stay; readers name the buckets themselves
    return read_bucketed(df.sparkSession, name, folder, df.schema, buckets, key, sort)


def publish_tables(
    spark: SparkSession, tables: dict[str, T.StructType], folder: str, names: Iterable[str] | None = None,
    views: bool = False,
) -> list[str]:
    """Makes stored tables queryable by name and returns the names; empty tables are skipped."""
    published = []
    for name in names or tables:
        table = read_table(spark, folder, name, tables[name])
        if table.isEmpty():
            continue
        if views:
            table.createOrReplaceTempView(name)
        else:
            table.write.mode("overwrite").saveAsTable(name)
        published.append(name)
    return published
