"""Registry of the analytics queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kernel, relational, series, sources, streaming, text, vectors

MODULES = (kernel, series, text, relational, vectors, sources, streaming)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
