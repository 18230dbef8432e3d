"""Sinks: JSON records, headerless CSV, score lines, minimum and maximum sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=False, mode="overwrite")


def score_lines(scores: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    """(seq, line): the columns of each record as comma-separated fixed decimals."""
    fields = [F.format_string(f"%.{decimals}f", F.col(c)) for c in columns]
    return scores.select("seq", F.concat_ws(",", *fields).alias("line"))


def write_scores(scores: DataFrame, columns: list[str], path: str, decimals: int = 6) -> None:
    score_lines(scores, columns, decimals).orderBy("seq").select("line").write.mode("overwrite").text(path)


def bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with min_<c> and max_<c>."""
    return df.agg(*[g(c).alias(f"{n}_{c}") for c in columns for n, g in (("min", F.min), ("max", F.max))])
