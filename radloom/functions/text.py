"""Blank tests, width, JSON size and date forms of imaging metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(col: Column) -> Column:
    """Null for null, empty and whitespace-only text; otherwise unchanged."""
    return F.when(F.length(F.trim(col)) > 0, col)


def is_blank(col: Column) -> Column:
    return F.coalesce(F.length(F.trim(col)) == 0, F.lit(True))


def same_ignoring_case(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def da_to_date(col: Column) -> Column:
    """``yyyyMMdd`` text to a date; null if it is not one."""
    return F.to_date(F.try_to_timestamp(col, F.lit("yyyyMMdd")))


def tm_to_seconds(col: Column) -> Column:
    """``HHmmss`` (fraction allowed) to seconds of the day."""
    part = lambda pos: F.substring(col, pos, 2).cast("int")
    return F.when(col.rlike(r"^([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9](\.[0-9]+)?$"),
                  part(1) * 3600 + part(3) * 60 + part(5)).cast("long")


def age_in_days(col: Column) -> Column:
    """``nnnD|W|M|Y`` age text to days (months of 30, years of 365 days)."""
    number = F.regexp_extract(col, r"^([0-9]{3})[DWMY]$", 1)
    unit = F.when(col.endswith("D"), 1).when(col.endswith("W"), 7).when(col.endswith("M"), 30).otherwise(365)
    return F.when(number != "", number.cast("int") * unit)


def clock_duration(seconds: Column) -> Column:
    """Seconds as ``[d.]hh:mm:ss``, the form durations take in job summaries."""
    whole = seconds.cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.expr("0") + (whole % 86400 / 3600).cast("long"),
                            (whole % 3600 / 60).cast("long"), whole % 60)
    days = (whole / 86400).cast("long")
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("."), clock)).otherwise(clock)
