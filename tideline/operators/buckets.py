"""Inspection of sketch buckets: the journal of what fell into each, its statistics, and its text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def journal(rows: DataFrame) -> DataFrame:
    """(k, feature, bucket, entries): the (value, score) of each bucket in each step, in order."""
    return rows.groupBy("k", "feature", "bucket").agg(F.array_sort(F.collect_list(F.struct("value", "score"))).alias("entries"))


def statistics(rows: DataFrame) -> DataFrame:
    """For each feature the buckets used, the distinct values, how often, and the values beyond one a bucket."""
    used, values = F.count_distinct("bucket"), F.count_distinct("value")
    return rows.groupBy("feature").agg(used.alias("used_buckets"), values.alias("unique_values"), F.count("*").alias("frequency"), (values - used).alias("surplus_values"))


def by_collisions(rows: DataFrame) -> DataFrame:
    """Buckets by number of distinct values, then frequency."""
    found = rows.groupBy("feature", "bucket").agg(F.count_distinct("value").alias("collisions"), F.count("*").alias("frequency"))
    return found.orderBy(F.desc("collisions"), F.desc("frequency"), "bucket")


def active_at(rows: DataFrame, step: int) -> DataFrame:
    """What each bucket holds at one step."""
    now = rows.where(F.col("k") == step)
    return now.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"), F.array_sort(F.collect_list("value")).alias("values"))


def decode(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Bucket values as labels; ``lookup`` has (code, label)."""
    return rows.join(lookup, rows["value"] == lookup["code"]).drop("code")


def dump(rows: DataFrame, buckets: int) -> DataFrame:
    """(k, line): one line for each step, ``[[(value,score),...],[],...]`` with the bucket as index."""
    pair = F.concat(F.lit("("), F.col("value").cast("string"), F.lit(","), F.col("score").cast("string"), F.lit(")"))
    cells = rows.groupBy("k", "bucket").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("]")).alias("cell"))
    lines = cells.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "cell"))).alias("at"))
    full = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("at", b), F.lit("[]")))
    return lines.select("k", F.concat(F.lit("["), F.array_join(full, ","), F.lit("]")).alias("line"))


def read_dump(lines: DataFrame) -> DataFrame:
    """(k, bucket, value, score) of the lines that ``dump`` writes."""
    text = F.translate("line", "()", "[]")
    at = lines.select("k", F.posexplode(F.from_json(text, "array<array<array<double>>>")).alias("bucket", "cell")).withColumn("bucket", F.col("bucket").cast("long"))
    return at.select("k", "bucket", F.explode("cell").alias("p")).select("k", "bucket", F.col("p")[0].alias("value"), F.col("p")[1].alias("score"))
