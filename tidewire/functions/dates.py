"""Date expressions. Values that cannot be read become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_timestamp(value: Column) -> Column:
    """Timestamp from an integer or string ``yyyyMMddHHmmss``."""
    return F.try_to_timestamp(value.cast("string"), F.lit("yyyyMMddHHmmss"))


def plain_date(value: Column) -> Column:
    return value.try_cast("date")


def day_first_date(value: Column) -> Column:
    """Date from ``dd/MM/yyyy``."""
    return F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).cast("date")


def day_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
