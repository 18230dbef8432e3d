"""Scans over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold appends one by one; longer arrays are scanned in blocks, since appending copies.
BLOCK = 256


def scan(xs: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state before x, x)`` for each x of ``xs``, with state moving by ``step``; ``kind`` is the type of the result."""
    empty = F.array().cast(kind)
    n_blocks = F.ceil(F.size(xs) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.filter(F.sequence(F.lit(0), n_blocks), lambda b: b < n_blocks), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def within(block: Column, start: Column) -> Column:
        folded = F.aggregate(
            block,
            F.struct(start.alias("s"), empty.alias("out")),
            lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(out(a["s"], x))).alias("out")),
        )
        return folded

    chained = F.aggregate(
        blocks,
        F.struct(zero.alias("s"), F.array().cast(f"array<{kind}>").alias("outs")),
        # bound by a lambda, so that a block is folded once
        lambda a, b: F.get(F.transform(F.array(within(b, a["s"])), lambda made: _join(a, made)), F.lit(0)),
        lambda a: a["outs"],
    )
    return F.flatten(chained)


def _join(a: Column, made: Column) -> Column:
    return F.struct(made["s"].alias("s"), F.concat(a["outs"], F.array(made["out"])).alias("outs"))
