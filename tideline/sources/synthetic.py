"""Synthetic streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def random_strings(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    """(id, word): n lower-case strings, the same for a seed whatever the partitioning."""
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(26)) + 1).cast("int"), F.lit(1))
    return spark.range(n).withColumn("word", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), ""))


def planted_text(ts: Column, tenth: str, fifth: str, other: Column) -> Column:
    """Text with anomalies by day: ``tenth`` on days divisible by 10, ``fifth`` on others divisible by 5, else ``other``."""
    day = F.dayofmonth(ts)
    return F.when(day % 10 == 0, F.lit(tenth)).when(day % 5 == 0, F.lit(fifth)).otherwise(other)


def random_words(key: Column, words: list[str], most: int = 4, seed: int = 0) -> Column:
    """Nothing for about half the keys, else up to ``most`` of ``words``; fixed by key and seed."""
    table = F.array(*[F.lit(w) for w in words])
    draw = lambda *x: F.pmod(F.xxhash64(F.lit(seed), key, *x), F.lit(1 << 30))
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(table, (draw(i) % len(words)).cast("int")))
    n = (draw(F.lit(-1)) % (most + 1)).cast("int")
    return F.when(draw(F.lit(-2)) % 2 == 0, F.lit("")).otherwise(F.array_join(F.slice(picked, F.lit(1), n), " "))


def seconds_from(start: Column, seq: Column) -> Column:
    """A time for record ``seq``: one a second."""
    return start + F.make_interval(secs=seq)
