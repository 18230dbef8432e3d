"""Time buckets and clocks, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ceil_bucket(ts: Column, seconds: int) -> Column:
    """The end of the bucket (start, end] that ``ts`` lies in: an edge is its own bucket."""
    width = seconds * 1_000_000
    x = micros(ts)
    return F.timestamp_micros(x + F.pmod(-x, F.lit(width)))


def floor_bucket(ts: Column, seconds: int) -> Column:
    """The start of the bucket [start, end) that ``ts`` lies in."""
    width = seconds * 1_000_000
    x = micros(ts)
    return F.timestamp_micros(x - F.pmod(x, F.lit(width)))


def epoch_seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / F.lit(1_000_000)).cast("long")


def epoch_millis(ts: Column) -> Column:
    return F.floor(micros(ts) / F.lit(1_000)).cast("long")


def record_timestep(value: Column, first: Column, divisor: int) -> Column:
    """Steps of ``divisor`` units since the first record's value."""
    return F.floor((value - first) / F.lit(divisor)).cast("long")
