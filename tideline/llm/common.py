"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, remove, run_dir, shared_dir

__all__ = ["checked_broadcast", "materialize", "release", "run_dir", "shared_dir", "string_weight", "text_of", "text_tag"]

#: Rows of at most a few dozen bytes each that may be broadcast after they have been counted.
BROADCAST_ROWS = 500_000


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, which nothing may read any more, and the shuffle
    files of jobs that are over: Spark drops those when the driver has collected its garbage.
    """
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if f"/{run_dir(spark).rsplit('/', 1)[1]}/" in path:
                remove(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def text_tag(name: str = "text") -> Column:
    """With doc_id, the identity of a row's content: equal rows share it."""
    return F.xxhash64(F.col(name))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted now), else without one.

    ``weight`` is for rows of no fixed size: how many small rows each stands for. The weights are summed over the
    whole table, so one huge row is no more broadcast than many small ones. Without the hint the join shuffles,
    and AQE splits its skewed partitions.
    """
    n = df.limit(rows + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= rows else df


def string_weight(name: str) -> Column:
    """The weight of a row that holds a string: one for each 64 bytes begun."""
    return F.floor(F.octet_length(F.coalesce(F.col(name), F.lit(""))) / 64) + 1
