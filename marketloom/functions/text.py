"""Cleaning of identifiers and numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Only plain decimal or exponent notation is a number. A bare try_cast would also accept 'NaN',
# 'Infinity', hexadecimal forms and Java suffixes such as '1.0d', all of which have other characters.
NUMBER_PATTERN = "^[0-9eE.+-]*[0-9.]$"


def normalize_id(raw: Column) -> Column:
    """Security id as text: trimmed, without the '.0' that numeric inference leaves."""
    return F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", "")


def without(raw: Column, mark: str) -> Column:
    return F.replace(raw, F.lit(mark), F.lit(""))


def number(text: Column) -> Column:
    """Double from bare number text; anything that is not a number is null. Uses the text twice."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def plain_number(raw: Column) -> Column:
    """Double from text with thousands commas."""
    return number(F.trim(without(raw.cast("string"), ",")))


def strict_number(raw: Column) -> Column:
    """Double from text without separators: '1,234' is no number here."""
    return number(F.trim(raw.cast("string")))


def price_text(raw: Column) -> Column:
    """Bare text of a price feed number: no commas, no plus signs ('+1,234.5', '--', '-')."""
    return F.trim(without(without(raw.cast("string"), ","), "+"))


def lower_snake(raw: Column) -> Column:
    return F.translate(F.lower(raw), " ", "_")
