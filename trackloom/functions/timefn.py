"""Instants: ``ts`` is a timestamp without zone that holds UTC, ``us`` the same as microseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Independent of the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def iso(ts: Column) -> Column:
    """ISO 8601 without a fraction of zeros."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def floor_to(us: Column, width: int) -> Column:
    """The start of the epoch-anchored bucket of ``width`` microseconds."""
    return us - F.pmod(us, F.lit(width))
