"""Instants and intervals. Times are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def instant(value: Column | datetime | str) -> Column:
    """The ``as_of`` argument of an operator as a column."""
    if isinstance(value, Column):
        return value.cast(NTZ)
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast(NTZ)


def iso_to_utc(text: Column) -> Column:
    """ISO text → UTC time; text that is no instant (``2 days ago``) → NULL.

    Text with an offset is moved to UTC, text without one is taken as UTC.
    """
    parsed = F.try_to_timestamp(text)
    wall = parsed.cast(NTZ)
    has_offset = text.rlike(r"T?\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})\s*$")
    moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall)
    return F.when(has_offset, moved).otherwise(wall)


def hours_before(moment: Column, hours: Column | int) -> Column:
    return moment - F.make_dt_interval(hours=_lit(hours))


def days_before(moment: Column, days: Column | int) -> Column:
    return moment - F.make_dt_interval(days=_lit(days))


def days_after(moment: Column, days: Column | int) -> Column:
    return moment + F.make_dt_interval(days=_lit(days))


def seconds_after(moment: Column, seconds: Column | int) -> Column:
    return moment + F.make_dt_interval(secs=_lit(seconds).cast("decimal(18,6)"))


def seconds_before(moment: Column, seconds: Column | int) -> Column:
    return moment - F.make_dt_interval(secs=_lit(seconds).cast("decimal(18,6)"))


def seconds_to_hours(seconds: Column) -> Column:
    return seconds / F.lit(3600.0)


def bytes_to_mb(size: Column) -> Column:
    return F.round(size / F.lit(1024.0 * 1024.0), 2)


def _lit(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
