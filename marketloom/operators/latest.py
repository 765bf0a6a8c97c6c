"""Last-row and last-value operators.

All of them are aggregates, not ``row_number`` windows. Spark combines an aggregate inside each
map task before the exchange, so a key that owns a third of the rows leaves every task as one row;
a window would send all of them to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.dates import month_of
from marketloom.operators.headers import FEED_ORDER

FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}


def _order(columns: Sequence[str | Column]) -> Column:
    items = [F.col(item) if isinstance(item, str) else item for item in columns]
    return items[0] if len(items) == 1 else F.struct(*items)


def keep_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = (FEED_ORDER,), without: Sequence[str] = ()
) -> DataFrame:
    """The whole row, but for the columns of ``without``, with the highest order value for each key; its nulls are kept.

    Fixed-width columns are picked one by one under a fixed-width order, which Spark does with hash
    aggregation; all picks of a key follow the same comparisons, so they come from one row. Other
    rows travel as one struct through a sort aggregation.
    """
    types = dict(df.dtypes)
    rest = [name for name in df.columns if name not in (*keys, *without)]
    if len(order) == 1 and all(types[name] in FIXED_WIDTH for name in [*rest, *order] if isinstance(name, str)):
        rank = _order(order)
        return df.groupBy(*keys).agg(*[F.max_by(name, rank).alias(name) for name in rest])
    # A struct is never null, so a row with a null order value can still win when it is the only one.
    last = F.max_by(F.struct(*rest), F.struct(_order(order)))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def last_non_null(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Per key and per column, the last value that is not null."""
    rank = _order(order)
    picks = [F.max_by(name, F.when(F.col(name).isNotNull(), rank)).alias(name) for name in columns]
    return df.groupBy(*keys).agg(*picks)


def month_end_rows(daily: DataFrame) -> DataFrame:
    """The last trading day's row of each stock and month, with the month added."""
    dated = daily.dropna(subset=["date"]).withColumn("month", month_of(F.col("date")))
    return keep_last(dated, ["stock_id", "month"], ["date"])


def latest_per_stock(df: DataFrame) -> DataFrame:
    """The last record of each stock by month, then latest price date, then date."""
    order = [name for name in ("month", "latest_price_date", "date") if name in df.columns]
    return keep_last(df, ["stock_id"], order).select(*df.columns)


def latest_month_rows(df: DataFrame) -> DataFrame:
    """Rows of the highest month. The month is a scalar subquery, so no join is needed."""
    return df.where(F.col("month") == df.select(F.max("month")).scalar())
