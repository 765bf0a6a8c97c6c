"""Unification of feed headers and of table layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Place of a row in its feed: a BIGINT below 2^56, or for rows read from files a struct (see sources.readers).
LANDING_ORDER = "landing_order"
PLACE_IN_FILES = "struct<file:string,start:bigint,row:bigint>"
# Place over several feeds: the feed's precedence above the place in the feed. Of BIGINT places it is one BIGINT,
# so that aggregates on it keep fixed-width buffers and Spark hash-aggregates them; of places in files, a struct.
FEED_ORDER = "feed_order"
PRECEDENCE_BIT = 56


def quoted(name: str) -> Column:
    """Column by its literal name; feed headers contain dots, dashes and parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def unify_headers(df: DataFrame, aliases: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """One column per canonical name, the first non-null of its aliases; absent names become null.

    Columns in ``keep`` pass through when the frame has them.
    """

    columns = set(df.columns)

    def merged(name: str) -> Column:
        present = [quoted(header) for header in aliases[name] if header in columns]
        return (F.coalesce(*present) if present else F.lit(None).cast("string")).alias(name)

    passed = [quoted(name) for name in keep if name in columns and name not in aliases]
    return df.select(*[merged(name) for name in aliases], *passed)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in order and type; absent ones are null."""
    types = {field.name: field.dataType for field in df.schema.fields}

    def typed(field: T.StructField) -> Column | str:
        if types.get(field.name) == field.dataType:
            return field.name
        value = F.col(field.name) if field.name in types else F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[typed(field) for field in schema.fields])


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name, with missing columns as null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def stack_sources(feeds: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of feeds in precedence order; a later feed wins a keep-last over an earlier one."""

    kinds = [dict(feed.dtypes).get(LANDING_ORDER) for feed in feeds]
    from_files = PLACE_IN_FILES in kinds

    def ordered(feed: DataFrame, kind: str | None, precedence: int) -> DataFrame:
        landed = F.col(LANDING_ORDER) if kind else F.lit(0)
        if from_files:
            if kind != PLACE_IN_FILES:
                landed = F.struct(F.lit("").alias("file"), F.lit(0).alias("start"), landed.alias("row"))
            place = F.struct(F.lit(precedence).alias("feed"), landed.cast(PLACE_IN_FILES).alias("place"))
        else:
            place = F.lit(precedence << PRECEDENCE_BIT).cast("bigint") + landed
        return feed.withColumn(FEED_ORDER, place).drop(LANDING_ORDER)

    return stack([ordered(feed, kind, precedence) for precedence, (feed, kind) in enumerate(zip(feeds, kinds))])
