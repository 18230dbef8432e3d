"""Time series of record counts, labels and rolling values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timebuckets import ceil_bucket, micros
from .prefix import running


def bucketed(df: DataFrame, ts: str, seconds: int, *aggregates: Column, name: str = "bucket") -> DataFrame:
    """Aggregates for each bucket (start, end] that has rows."""
    return df.groupBy(ceil_bucket(F.col(ts), seconds).alias(name)).agg(*aggregates)


def resampled_sum(df: DataFrame, ts: str, value: str, seconds: int) -> DataFrame:
    """(bucket, total) over every bucket [start, end) between the first and the last, 0 where there are no rows."""
    width = seconds * 1_000_000
    rows = df.groupBy(F.floor(micros(F.col(ts)) / F.lit(width)).alias("b")).agg(F.sum(value).alias("total"))
    spine = rows.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("b"))
    return spine.join(rows, "b", "left").select(F.timestamp_micros(F.col("b") * width).alias("bucket"), F.coalesce("total", F.lit(0)).alias("total"))


def running_distinct(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """(bucket, seen): distinct values up to and including each bucket."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(bucket).alias("b")).groupBy("b").agg(F.count("*").alias("new"))
    spine = df.select(F.col(bucket).alias("bucket")).distinct()
    rows = spine.join(first, spine["bucket"] == first["b"], "left")
    return rows.select("bucket", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("bucket")).alias("seen"))


def spike_runs(df: DataFrame, key: str, order: str, value: str, cutoff: float) -> DataFrame:
    """(key, spikes): maximal runs of rows above ``cutoff``."""
    w = Window.partitionBy(key).orderBy(order)
    hit = F.coalesce(F.col(value) > cutoff, F.lit(False))
    rows = df.withColumn("__hit", hit).withColumn("__starts", F.col("__hit") & ~F.coalesce(F.lag("__hit").over(w), F.lit(False)))
    return rows.groupBy(key).agg(F.count_if("__starts").alias("spikes"))


def cumulative_with_reset(df: DataFrame, key: str, order: str, value: str, reset: str) -> DataFrame:
    """``df`` with ``running``: the sum of ``value`` since the last row of its key where ``reset`` held, that row included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__run", F.sum(F.col(reset).cast("long")).over(w))
    inside = Window.partitionBy(key, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(inside)).drop("__run")


def rolling_average(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """``df`` with ``rolling``, the mean of the last ``n`` rows of the key."""
    return df.withColumn("rolling", F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)))


def linear_anomaly(df: DataFrame, key: str, x: str, y: str, season: Column | None = None) -> DataFrame:
    """``df`` with ``anomaly``: residual from the key's least-squares line in residual standard deviations; 0 if there are none.

    A baseline in place of a trained forecast model: trend, and if ``season`` is given (as a day of the week) what
    residuals of a season have in common.
    """
    fit = df.groupBy(key).agg(F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__i"))
    rows = df.join(fit, key).withColumn("__r", F.col(y) - (F.col("__s") * F.col(x) + F.col("__i")))
    if season is not None:
        rows = rows.withColumn("__w", season)
        usual = rows.groupBy(F.col(key).alias("__k"), F.col("__w").alias("__v")).agg(F.avg("__r").alias("__u"))
        rows = rows.join(usual, (F.col(key) == F.col("__k")) & F.col("__w").eqNullSafe(F.col("__v"))).withColumn("__r", F.col("__r") - F.col("__u")).drop("__k", "__w", "__v", "__u")
    spread = rows.groupBy(key).agg(F.stddev_samp("__r").alias("__d"))
    score = F.when(F.col("__d") > 1e-9, F.col("__r") / F.col("__d")).otherwise(F.lit(0.0))
    return rows.join(spread, key).withColumn("anomaly", F.coalesce(score, F.lit(0.0))).drop("__s", "__i", "__r", "__d")


def sliding_slices(df: DataFrame, seq: str, width: int, step: int, slices: int) -> DataFrame:
    """``df`` once for each overlapping slice [i * step, i * step + width) that holds its number (from 0)."""
    first = F.greatest(F.floor((F.col(seq) - width) / F.lit(step)) + 1, F.lit(0))
    last = F.least(F.floor(F.col(seq) / F.lit(step)), F.lit(slices - 1))
    ids = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    return df.withColumn("slice", F.explode(ids))


def running_bounds(df: DataFrame, seq: str, value: str) -> DataFrame:
    """``df`` with the running minimum and maximum of ``value``."""
    return running(df, seq, {"low": ("min", F.col(value)), "high": ("max", F.col(value))})


def top_values_series(df: DataFrame, ts: str, entity: str, seconds: int, n: int = 3) -> DataFrame:
    """(bucket, total, top1 .. topN): counts of each bucket, in all and of the n most frequent entities (ties by name)."""
    counts = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n")).orderBy(F.desc("n"), entity).limit(n)
    names = [r[entity] for r in counts.collect()]  # n names
    columns = [F.count_if(F.col(entity) == v).alias(f"top{i}") for i, v in enumerate(names, 1)]
    return bucketed(df, ts, seconds, F.count("*").alias("total"), *columns)
