"""Rounding and guarded logarithms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Half up for positive values; negative ones that aren't whole go down."""
    scaled = x * F.lit(10.0**digits)
    down = F.floor(scaled)
    return F.when(F.abs(scaled) - F.abs(down) < 0.5, down).otherwise(F.ceil(scaled)).cast("double") / F.lit(10.0**digits)


def short_key(x: Column) -> Column:
    """Text of a number as six significant digits show it: 5 decimals, 4 beyond 10, none if whole."""
    rounded = F.when(F.abs(x) > 10, F.round(x, 4)).otherwise(F.round(x, 5))
    return F.when(rounded == F.floor(rounded), rounded.cast("long").cast("string")).otherwise(rounded.cast("string"))


def guarded_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def binary_label(label: Column, normal: str) -> Column:
    """0 for the label that is normal, 1 for any other, null for null."""
    return F.when(label.isNotNull(), (label != normal).cast("int"))
