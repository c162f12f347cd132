"""Times as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone; a time with zone is read in the session's."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    """The time without zone that is so many microseconds after 1970."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))


def clock(time: Column) -> Column:
    """A time as watermarks need it, on the scale of `micros`."""
    return F.timestamp_micros(micros(time))
