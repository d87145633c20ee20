"""Record serialisation and clock columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def utc_iso_now() -> Column:
    """Current time as an ISO string with microseconds (UTC session)."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))
