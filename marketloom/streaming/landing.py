"""Incremental landing: appending new feed rows to what is already held, and planning what to fetch."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dates import month_of
from marketloom.operators.headers import LANDING_ORDER, stack
from marketloom.operators.latest import keep_last
from marketloom.sources.readers import path_exists

# The earliest month the price feed serves, and the key columns of its rows.
EARLIEST_MONTH = "2010-01-01"
HISTORY_KEY = ("stock_id", "日期")


def append_snapshot(held: DataFrame, incoming: DataFrame, run_date: Column | str) -> DataFrame:
    """Held and new snapshot rows without full duplicates; rows without a snapshot date get the run date."""
    if "snapshot_date" not in incoming.columns:
        stamp = F.lit(run_date) if isinstance(run_date, str) else run_date
        incoming = incoming.withColumn("snapshot_date", stamp.cast("string"))
    return stack([held, incoming]).dropDuplicates()


def append_history(
    held: DataFrame, incoming: DataFrame, keys: Sequence[str] = HISTORY_KEY, order: Sequence[str] = ()
) -> DataFrame:
    """Held and new rows, the last per key: new beats held, then the given order within a load, which is the
    landing order unless one is named. Without any order the winner would be left to chance, so that is an error."""
    if not order and LANDING_ORDER in held.columns and LANDING_ORDER in incoming.columns:
        order = (LANDING_ORDER,)
    if not order:
        raise ValueError(f"rows of one key need an order: name columns, or give both sides a {LANDING_ORDER}")
    loads = stack([held.withColumn("_load", F.lit(0)), incoming.withColumn("_load", F.lit(1))])
    return keep_last(loads, keys, ["_load", *order]).drop("_load")


def merge_history(
    incoming: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], partition: str = "query_month"
) -> None:
    """Merges a load into a Parquet table with one row per key, partitioned by a column that the key decides.

    Of the load, the last row per key in the given order counts, and it replaces the held row. Only partitions with a row
    that is new or differs are read whole and written again, by dynamic overwrite; so a load that is repeated changes nothing.
    """
    if not order:
        raise ValueError("rows of one key need an order")
    spark = incoming.sparkSession
    last = keep_last(incoming, keys, order).select(*incoming.columns)
    merged = last
    if path_exists(spark, path):
        held = spark.read.schema(incoming.schema).parquet(path).select(*incoming.columns)
        months = last.select(partition).distinct()
        near = held.join(months, partition, "left_semi").select(*[F.col(name).alias(f"held_{name}") for name in held.columns])
        same = [F.col(name).eqNullSafe(F.col(f"held_{name}")) for name in held.columns]
        fresh = last.join(near, reduce(Column.__and__, same), "left_anti")
        touched = held.join(fresh.select(partition).distinct(), partition, "left_semi").select(*incoming.columns)
        merged = append_history(touched, fresh, keys, order).select(*incoming.columns)
    writer = merged.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def missing_months(
    stocks: DataFrame, held: DataFrame, start: Column, end: Column, earliest: str = EARLIEST_MONTH
) -> DataFrame:
    """(stock_id, query_month) pairs between the bounds that are not held yet."""
    first = F.greatest(F.trunc(start, "month"), F.lit(earliest).cast("date"))
    last = F.trunc(end, "month")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    wanted = stocks.select("stock_id").distinct().select("stock_id", F.explode(months).alias("month_start"))
    planned = wanted.select("stock_id", month_of(F.col("month_start")).alias("query_month"))
    return planned.join(held.select("stock_id", "query_month").dropna(), ["stock_id", "query_month"], "left_anti")
