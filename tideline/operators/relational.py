"""Joins by key or place, set operations and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_references(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """``df`` with ``missing``: whether its key is not among the known ones; a null key is missing."""
    keys = known.select(F.col(known_key).alias("__known")).distinct()
    return df.join(keys, df[key] == keys["__known"], "left").withColumn("missing", F.col("__known").isNull()).drop("__known")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, defaults: dict[str, object]) -> DataFrame:
    """``df`` with columns looked up in ``table`` (one row a key), defaults where the key is absent.

    Catalyst broadcasts the table if its size allows.
    """
    found = table.select(F.col(table_key).alias("__key"), *defaults)
    rows = df.join(found, df[key] == found["__key"], "left").drop("__key")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items() if v is not None})


def zipped(a: DataFrame, b: DataFrame, seq: str) -> DataFrame:
    """Row i of ``a`` with row i of ``b``, both numbered by the unique ``seq``."""
    return a.join(b, seq)


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, with the columns they share."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def quantile_bins(df: DataFrame, value: str, q: int) -> DataFrame:
    """``df`` with ``bin`` from 0: right-closed bins between exact quantiles."""
    edges = df.agg(F.percentile(value, [i / q for i in range(1, q)]).alias("e")).first()["e"] or []
    return df.withColumn("bin", F.size(F.filter(F.array(*[F.lit(x).cast("double") for x in edges]), lambda x: x < F.col(value))).cast("long"))


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``df`` with ``bin`` from 0: right-closed bins of equal width, the lowest value in the first."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    width = ((ends["hi"] or 0) - (ends["lo"] or 0)) / bins
    at = F.lit(0.0) if not width else F.ceil(F.round((F.col(value) - F.lit(ends["lo"])) / F.lit(width), 9)) - 1
    return df.withColumn("bin", F.greatest(at.cast("long"), F.lit(0).cast("long")))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)
