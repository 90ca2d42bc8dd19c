"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names by weekday number, Sunday first.
WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def as_instant(ts: Column) -> Column:
    """Wall-clock UTC or instant to an instant (session time zone UTC)."""
    return ts.cast("timestamp")


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def cut_hours(ts: Column, start: Column, stop: Column) -> Column:
    """Hour bin of an instant; NULL outside ``[start, stop)``."""
    return F.when((ts >= start) & (ts < stop), floor_hour(ts))


def local_time(ts: Column, zone: Column) -> Column:
    """Wall-clock time in the row's own zone."""
    return F.convert_timezone(F.lit("UTC"), zone, ts.cast("timestamp_ntz"))


def weekday(date: Column) -> Column:
    """0 for Sunday … 6 for Saturday."""
    return F.dayofweek(date) - 1


def weekday_name(day: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), day + 1)


def column_instant(name: Column) -> Column:
    """Instant from a raster column name; a bare date means midnight."""
    return name.cast("timestamp")
