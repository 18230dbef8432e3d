"""Streaming queries run to their end, with the SQL of the same over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import encoder as E
from ..streaming import scorer as T
from . import kernel

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _files(rows: DataFrame, parts: int) -> tuple[str, DataFrame]:
    """``rows`` (with seq) in ``parts`` consecutive folders, and the stream that reads them one by one in order."""
    spark = rows.sparkSession
    n = (rows.agg(F.max("seq").alias("n")).first()["n"] or 0) + 1
    folder = T.new_folder(spark)
    for p in range(parts):
        rows.where((F.col("seq") >= n * p // parts) & (F.col("seq") < n * (p + 1) // parts)).coalesce(1).write.parquet(f"{folder}/in/{p}")
    return folder, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


@query(f"""{kernel._kernel(kernel._PLAIN, kernel._code_cells('user_code'), kernel._code_cells('type_code'))}
select seq, k, round(ln(1 + sum(s)), 6) as score, round(ln(1 + max(case when feature = 'user_code' then s end)), 6) as user_code_score from sc group by seq, k""")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, stream = _files(kernel.stream(spark, sf_dir).select("seq", "t", "user_code", "type_code"), 3)
    scorer = T.StreamScorer(spark, ["user_code", "type_code"], kernel.PARAMS, folder)
    scorer.run(stream).awaitTermination()
    return scorer.scores().select("seq", "k", F.round("score", 6).alias("score"), F.round("user_code_score", 6).alias("user_code_score"))


@query(kernel.SQL["score_combined"])
def stream_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, codes and the record in three batches, against one batch over all."""
    folder, stream = _files(kernel.stream(spark, sf_dir), 3)
    scorer = T.StreamScorer(spark, kernel.CODES, kernel.PARAMS, folder, record=True, numeric=kernel.NUMERIC)
    scorer.run(stream).awaitTermination()
    return scorer.scores().select("seq", "k", *[F.round(c, 6).alias(c) for c in ["score", *[f"{x}_score" for x in ["record", *kernel.NUMERIC, *kernel.CODES]]]])


@query("""with f as (select user_id, row_number() over (order by min(event_id)) as code from events group by 1), g as (select event_type, row_number() over (order by min(event_id)) as code from events group by 1),
o as (select epoch_us(ts) // 1000000 as first from events order by event_id limit 1)
select event_id as seq, f.code as user_id, g.code as event_type, cast(floor((epoch_us(ts) // 1000000 - first) / 21600.0) as bigint) as step from events join f using (user_id) join g using (event_type), o""")
def stream_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen codes and steps of a stream in four batches, against one numbering of all."""
    rows = _events(spark, sf_dir)
    rows = rows.select("seq", "user_id", "event_type", F.floor(F.unix_micros("ts") / F.lit(1_000_000)).cast("long").alias("seconds"))
    folder, stream = _files(rows, 4)
    encoder = E.StreamEncoder(spark, ["user_id", "event_type"], folder, step="seconds", width=21600)
    encoder.run(stream).awaitTermination()
    return encoder.codes().select("seq", "user_id", "event_type", "step")


@query("select cast(floor(epoch_us(ts) / 86400000000.0) as bigint) as day, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, stream = _files(_events(spark, sf_dir), 2)
    rows = T.run_to_end(T.windowed_counts(stream, "ts", "event_type", "1 day", "400 days"), folder, "complete")
    return rows.select(F.floor(F.unix_seconds("start") / 86400).cast("long").alias("day"), "event_type", "n")


@query("with e as (select event_type, cast(floor(epoch_us(ts) / 86400000000.0) as bigint) as day from events) select day - back as day, event_type, count(*) as n from e, range(2) t(back) group by 1, 2")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days that begin every day."""
    folder, stream = _files(_events(spark, sf_dir), 2)
    rows = T.run_to_end(T.windowed_counts(stream, "ts", "event_type", "2 days", "400 days", "1 day"), folder, "complete")
    return rows.select(F.floor(F.unix_seconds("start") / 86400).cast("long").alias("day"), "event_type", "n")


@query("""with g as (select user_id, epoch_us(ts) as t, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events),
s as (select *, sum(case when gap is null or gap >= 86400000000 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as session from g)
select user_id, min(t) as start_us, max(t) + 86400000000 as end_us, count(*) as n from s group by user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, stream = _files(_events(spark, sf_dir), 2)
    rows = T.run_to_end(T.sessions(stream, "ts", "user_id", "1 day", "400 days"), folder, "complete")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("select user_id, min(event_id) as first from events group by 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each user, over a stream in batches that hold many rows of a user."""
    folder, stream = _files(_events(spark, sf_dir), 4)
    return T.deduplicated(stream, "ts", "user_id", "seq", "400 days", folder).select("user_id", F.col("seq").alias("first"))
