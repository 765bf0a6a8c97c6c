"""Dates and months, including the ROC calendar (year 1 = 1912)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar offset and the feed date shapes.
ROC_YEAR_OFFSET = 1911
COMPACT_DATE = "^([0-9]{3,4})([0-9]{2})([0-9]{2})$"  # yyyMMdd (ROC) or yyyyMMdd
FOUR_DIGIT_YEAR = "^[0-9]{4}(-.*)?$"
COMPACT_ROC_DATE = "^[0-9]{7}$"
QUARTER = "^[0-9]{4}[Qq][1-4]$"
ROC_MONTH = "^[0-9]{5}$"
COMPACT_MONTH = "^[0-9]{4}(0[1-9]|1[0-2])$"
WHOLE_NUMBER = r"\.0*$"
MONTH_FORMAT = "yyyy-MM"


def _dashed(text: Column) -> Column:
    """Compact, slash and dot dates in the Y-M-D order of an ISO date."""
    return F.translate(F.regexp_replace(text, COMPACT_DATE, "$1-$2-$3"), "/.", "--")


def _year(dashed: Column) -> Column:
    return F.substring_index(dashed, "-", 1).try_cast("int")


def _calendar_date(dashed: Column) -> Column:
    """DATE, or null for text that is no date and for days that do not exist.

    The argument is used once: Spark repeats it when it pushes a filter on the result down.
    """
    return F.regexp_extract(dashed, FOUR_DIGIT_YEAR, 0).try_cast("date")


def trade_date(raw: Column) -> Column:
    """DATE from 'Y/M/D' (ROC or Gregorian year), ROC 'yyyMMdd', or a Gregorian text date."""
    dashed = _dashed(F.trim(raw.cast("string")))
    year = _year(dashed)
    gregorian = F.concat_ws("-", (year + ROC_YEAR_OFFSET).cast("string"), F.substring_index(dashed, "-", -2))
    in_roc_form = (year < ROC_YEAR_OFFSET) & ~raw.contains("-")
    return _calendar_date(F.when(in_roc_form, gregorian).otherwise(dashed))


def plain_date(raw: Column) -> Column:
    """DATE from a Gregorian text date; no ROC years."""
    return _calendar_date(_dashed(F.trim(raw.cast("string"))))


def statement_date(raw: Column) -> Column:
    """ISO text of a statement date. Text that is no date is kept, as it still keys the rows."""
    text = F.trim(raw.cast("string"))
    roc_year = (F.substring(text, 1, 3).try_cast("int") + ROC_YEAR_OFFSET).cast("string")
    first_month = F.lpad((F.substring(text, 6, 1).try_cast("int") * 3 - 2).cast("string"), 2, "0")
    return (
        F.when(
            text.rlike(COMPACT_ROC_DATE),
            F.concat_ws("-", roc_year, F.substring(text, 4, 2), F.substring(text, 6, 2)),
        )
        .when(text.rlike(QUARTER), F.concat_ws("-", F.substring(text, 1, 4), first_month, F.lit("01")))
        .otherwise(F.coalesce(_calendar_date(_dashed(text)).cast("string"), text))
    )


def month_of(day: Column) -> Column:
    return F.date_format(day, MONTH_FORMAT)


def feed_month(raw: Column) -> Column:
    """'yyyy-MM' from ROC 'yyyMM' or Gregorian 'yyyyMM'; whole numbers such as 11302.0 count."""
    text = F.regexp_replace(F.trim(raw.cast("string")), WHOLE_NUMBER, "")
    roc_year = (F.substring(text, 1, 3).try_cast("int") + ROC_YEAR_OFFSET).cast("string")
    return F.when(text.rlike(ROC_MONTH), F.concat_ws("-", roc_year, F.substring(text, 4, 2))).when(
        text.rlike(COMPACT_MONTH), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))
    )


def year_month(year: Column, month: Column) -> Column:
    """'yyyy-MM' from separate year and month columns; null when either is missing or no number."""
    whole_year = year.try_cast("double").try_cast("int")
    whole_month = month.try_cast("double").try_cast("int")
    return F.concat(whole_year.cast("string"), F.lit("-"), F.lpad(whole_month.cast("string"), 2, "0"))


def latest_friday(day: Column) -> Column:
    """Most recent Friday on or before the day (weekday: Monday = 0, Friday = 4)."""
    return F.date_sub(day, F.pmod(F.weekday(day) - 4, F.lit(7)).cast("int"))


def five_years_before(day: Column) -> Column:
    return month_of(F.add_months(day, -60))
