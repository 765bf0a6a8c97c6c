"""Per-stock time series columns.

The windows partition by ``stock_id`` over inputs that hold one row per stock and day (or month).
Such a partition is bounded by the calendar, about 250 rows a year, however many raw rows the stock
had, because the keep-last aggregate before it has already folded them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.rules import above, change


def add_price_features(prices: DataFrame) -> DataFrame:
    """Returns, moving averages, volatility and flags for one row per (stock_id, date).

    Every window sorts by (stock_id, month, date): month follows from date, so this is also the
    date order, and one exchange with one sort serves all of them. Spark adds up a sliding frame anew
    for every row, so the 60 rows are added up as three runs of 20, of which one is the row's own.
    """
    days = Window.partitionBy("stock_id").orderBy("month", "date")
    month = Window.partitionBy("stock_id", "month").orderBy("date")
    whole_month = month.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    twenty = days.rowsBetween(-19, 0)
    close = F.col("close_price")

    def of_three(run: str) -> Column:
        earlier = [F.coalesce(F.lag(run, back).over(days), F.lit(0)) for back in (40, 20)]
        return earlier[0] + earlier[1] + F.coalesce(F.col(run), F.lit(0))

    return (
        prices.withColumn("month", F.trunc("date", "month"))
        .withColumns(
            {
                "_previous_close": F.lag(close).over(days),
                "_sum": F.sum(close).over(twenty),
                "_count": F.count(close).over(twenty),
            }
        )
        .withColumn("daily_return", change(close, F.col("_previous_close")))
        .withColumns(
            {
                "ma_20": F.col("_sum") / F.nullif("_count", F.lit(0)),
                "ma_60": of_three("_sum") / F.nullif(of_three("_count"), F.lit(0)),
                "volatility_20d": F.stddev_samp("daily_return").over(twenty),
            }
        )
        .withColumns(
            {
                # The row before a month's first day is the previous month's last day.
                "monthly_return": change(
                    F.last(close).over(whole_month), F.first("_previous_close").over(whole_month)
                ),
                "price_above_ma20_flag": above(close, F.col("ma_20")),
                "price_above_ma60_flag": above(close, F.col("ma_60")),
            }
        )
        .drop("_previous_close", "_sum", "_count", "month")
    )


def add_revenue_growth(revenue: DataFrame, fill: str = "pad") -> DataFrame:
    """Month and 12-row growth for one row per (stock_id, month).

    The 12 are present rows, not calendar months. With ``fill='pad'`` a null revenue takes the
    last known one; with ``fill='none'`` it stays null.
    """
    months = Window.partitionBy("stock_id").orderBy("month")
    so_far = months.rowsBetween(Window.unboundedPreceding, 0)
    known = F.last("revenue", ignorenulls=True).over(so_far) if fill == "pad" else F.col("revenue")
    base = F.col("_base")
    return (
        revenue.withColumn("_base", known)
        .withColumns(
            {
                "revenue_mom": change(base, F.lag(base, 1).over(months)),
                "revenue_yoy": change(base, F.lag(base, 12).over(months)),
            }
        )
        .drop("_base")
    )
