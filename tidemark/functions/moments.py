"""Date and time functions (section 2.10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone_name(zone: Column) -> Column:
    """``America/New_York`` of ``America/New_York (UTC-05:00)``."""
    return F.split(zone, r" \(").getItem(0)


def local_to_utc(text: Column, zone: Column) -> Column:
    """A local time, with or without fractions of a second, as the instant in UTC.

    A local time that a change of clocks skips is read with the offset before it.
    """
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.to_utc_timestamp(parsed, zone_name(zone))


def mixed_instant(text: Column) -> Column:
    """An instant from an ISO string, also with Z, or from epoch seconds as text."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("double")))


def twelve_hour(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd hh:mm:ss a")


def from_twelve_hour(text: Column) -> Column:
    """The instant of ``2024-01-31 04:05:06 PM``, null for any other form."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd hh:mm:ss a"))


def epoch(at: Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_timestamp(at)


def of_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def as_utc(naive: Column, fill: Column | None = None) -> Column:
    """A zone-less time read as UTC, with ``fill`` where it is null."""
    at = naive.cast("timestamp")
    return at if fill is None else F.coalesce(at, fill)


def date_prefix(text: Column) -> Column:
    """The date a text begins with, null without one."""
    return F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
