"""Durations: whole seconds between zone-free timestamps and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the largest duration a MySQL TIME can hold, 838:59:59.
TIME_LIMIT_SECONDS = 3020399


def micros_between(start: Column, end: Column) -> Column:
    """Exact microseconds from start to end, as a whole decimal."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1000000)).cast("decimal(24,0)")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, rounded half away from zero."""
    span = (end - start).cast("interval second").cast("decimal(18,6)")
    return F.round(span, 0).cast("bigint")


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def _minutes_and_seconds(size: Column) -> Column:
    minutes = _div(size % 3600, 60).cast("string")
    seconds = (size % 60).cast("string")
    return F.concat(F.lit(":"), F.lpad(minutes, 2, "0"), F.lit(":"), F.lpad(seconds, 2, "0"))


def _signed(seconds: Column, text: Column) -> Column:
    return F.when(seconds < 0, F.concat(F.lit("-"), text)).otherwise(text)


def hms(seconds: Column) -> Column:
    """`H:MM:SS`, hours unbounded and unpadded; null stays null."""
    size = F.abs(seconds)
    hours = _div(size, 3600).cast("string")
    return _signed(seconds, F.concat(hours, _minutes_and_seconds(size)))


def report_hms(seconds: Column) -> Column:
    """`HH:MM:SS`, hours padded to two digits; null stays null."""
    size = F.abs(seconds)
    hours = _div(size, 3600)
    padded = F.when(hours < 10, F.lpad(hours.cast("string"), 2, "0")).otherwise(hours.cast("string"))
    return _signed(seconds, F.concat(padded, _minutes_and_seconds(size)))


def hms_to_seconds(text: Column) -> Column:
    """Inverse of `hms`; null for text that is no duration."""
    parts = F.split(F.ltrim(text, F.lit("-")), ":")
    hours, minutes, seconds = (parts[i].cast("bigint") for i in range(3))
    size = hours * 3600 + minutes * 60 + seconds
    signed = F.when(text.startswith("-"), -size).otherwise(size)
    return F.when(text.rlike(r"^-?\d+:\d\d:\d\d$"), signed)


def clip_time(seconds: Column, limit: int | None = TIME_LIMIT_SECONDS) -> Column:
    """Clip to the range of a MySQL TIME; `limit=None` leaves seconds alone."""
    if limit is None:
        return seconds
    limit_col = F.lit(limit).cast("bigint")
    return F.when(seconds > limit, limit_col).when(seconds < -limit, -limit_col).otherwise(seconds)
