"""Date parsing without exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def readable_date(text: Column) -> Column:
    """``YYYYMMDD``, ``YYYYMMDD.0`` or ``YYYY-MM-DD`` as a date, anything else as null."""
    trimmed = F.trim(text)
    digits = F.when(trimmed.rlike(r"^\d{8}(\.0+)?$"), F.substring(trimmed, 1, 8)).when(
        trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace(trimmed, F.lit("-"), F.lit(""))
    )
    return F.try_to_date(digits, "yyyyMMdd")


def eight_digits(text: Column) -> Column:
    """The first run of eight digits as a date; null when there is none or it is no date."""
    return F.try_to_date(F.regexp_substr(text, F.lit(r"\d{8}")), "yyyyMMdd")


def float_date(text: Column) -> Column:
    """A date that came through a float column: missing counts as 0, which is no date."""
    number = text.try_cast("double")
    known = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
    whole = F.when(known, number).otherwise(0.0).cast("long").cast("string")
    return F.try_to_date(whole, "yyyyMMdd")


def date_int(date: Column) -> Column:
    """A date as the integer yyyymmdd."""
    return F.date_format(date, "yyyyMMdd").cast("int")


def date_label(date: Column) -> Column:
    """A date as ``07 Aug 2026``."""
    return F.date_format(date, "dd MMM yyyy")
