"""Queries that pass tables through the readers, with the SQL they are checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources import sinks as K
from ..tables import run_dir

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder among those that driver and executors share."""
    return f"{run_dir(spark)}/{uuid.uuid4().hex}"


@query("select doc_id, source as user_id, strftime(make_timestamp(1704067200000000 + doc_id * 1000000), '%Y-%m-%d %H:%M:%S') as created, array_to_string([lang, source], ',') as hashtags, '' as mentions, n_chars as like_count, case when doc_id % 3 = 0 then cast(doc_id + 1 as varchar) end as quoted from documents")
def json_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as nested post responses and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    post = F.struct(
        F.col("doc_id").cast("string").alias("id"), "text", F.date_format(F.timestamp_seconds(F.col("doc_id") + 1704067200), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), F.col("source").alias("author_id"),
        F.struct(F.array(F.struct(F.col("lang").alias("tag")), F.struct(F.col("source").alias("tag"))).alias("hashtags")).alias("entities"), F.struct(F.col("n_chars").alias("like_count")).alias("public_metrics"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("quoted").alias("type"), F.lit("0").alias("id")), F.struct(F.lit("quoted").alias("type"), (F.col("doc_id") + 1).cast("string").alias("id")))).alias("referenced_tweets"),
    )
    path = _folder(spark)
    docs.select(F.array(post).alias("data")).write.json(path)
    rows = R.flat_posts(spark.read.schema(f"data array<struct<{R.POST}>>").json(path).select(F.explode("data").alias("p")).select("p.*"))
    return rows.select(F.col("id").cast("long").alias("doc_id"), "user_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.array_join("hashtags", ",").alias("hashtags"), F.array_join("mentions", ",").alias("mentions"), "like_count", "quoted")


@query("select event_id as id, epoch_us(ts) // 1000 as created_ms, lower(event_type) as tags, case when event_id % 2 = 0 then null else 'r' end as retweeted, case when event_id % 2 = 0 then user_id else 0 end as retweet_count from events")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = _folder(spark)
    K.write_json(events.select(F.col("event_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.array(F.upper("event_type")).alias("hashtags"),
                               F.when(F.col("event_id") % 2 == 0, "None").otherwise("r").alias("retweeted"), F.col("user_id").alias("retweet_count")), path)
    rows = R.record_posts(spark, path)
    return rows.select(F.col("id").cast("long").alias("id"), F.unix_millis("created_at").alias("created_ms"), F.array_join("hashtags", ",").alias("tags"), "retweeted", "retweet_count")


@query("select event_id, value, user_id from events")
def headerless_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    K.write_csv(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id"), path)
    return R.headerless_csv(spark, path, "event_id bigint, value double, user_id bigint")


@query("select c_custkey, c_name, c_acctbal from customer")
def headed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return R.headed_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("select 'w' || vec_id as word, len(embedding) as dims, round(cast(embedding[1] as double), 5) as first from embeddings")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the lines of a word-vector file, parsed again."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lines = rows.select((F.col("vec_id") + 1).alias("n"), F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.transform("embedding", lambda x: x.cast("string"))).alias("value"))
    header = spark.createDataFrame([(0, "header")], "n long, value string")
    return R.word_vectors(lines.union(header)).select("word", F.size("vec").cast("long").alias("dims"), F.round(F.col("vec")[0].cast("double"), 5).alias("first"))


@query("select event_id as seq, printf('%.2f,%.2f', value, cast(event_id % 7 as double)) as line from events")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "value", (F.col("event_id") % 7).cast("double").alias("m7"))
    return K.score_lines(rows, ["value", "m7"], 2)


@query("select row_number() over (order by ts, event_id) - 1 as seq, epoch_us(ts) // 1000000 as t, value, user_id, event_id as id, case when row_number() over (partition by event_id order by ts) > 1 then 1 else 0 end as ignore from events")
def record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    out = R.record_stream(rows, ["value"], ["user_id"], "s", ["ts", "event_id"], "event_id")
    return out


@query("select o_orderkey as key, row_number() over (order by o_orderkey) - 1 as n, o_totalprice as price from orders")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several files, numbered over all of them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat_ws(",", "o_orderkey", "o_totalprice").alias("line"), "o_orderkey")
    path = _folder(spark)
    orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select("line").write.text(path)
    parts = F.split("value", ",")
    return R.numbered_lines(spark, path).select(parts[0].cast("long").alias("key"), "n", parts[1].cast("double").alias("price"))


@query("""select event_id as n, case when event_id % 4 = 0 then 1 else 2 end as size, round(value + case when event_id % 4 = 0 then 0 else user_id end, 6) as total from events where event_id % 10 <> 3""")
def headerless_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with comments and with words that are no numbers: rows shorten and keep their line's number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    second = F.when(F.col("event_id") % 4 == 0, F.lit("none")).otherwise(F.col("user_id").cast("string"))
    line = F.concat(F.when(F.col("event_id") % 10 == 3, F.lit("#")).otherwise(F.lit("")), F.concat_ws(",", F.col("value").cast("string"), second))
    path = _folder(spark)
    events.select(line.alias("line"), "event_id").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("line").write.text(path)
    rows = R.number_lists(R.numbered_lines(spark, path))
    return rows.select("n", F.size("values").cast("long").alias("size"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("select event_id as seq, printf('%.2f', value) as line from events")
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score lines written as a text file in order and read back by their numbers."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "value")
    path = _folder(spark)
    K.write_scores(rows, ["value"], path, 2)
    return R.numbered_lines(spark, path).select(F.col("n").alias("seq"), F.col("value").alias("line"))


@query("select event_id, case when event_type = 'view' then 0 else 1 end as label, strftime(make_timestamp(1704067200000000 + event_id * 1000000), '%Y-%m-%d %H:%M:%S') as time from events")
def labelled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels ``name.`` as 0 for the normal one and 1 for others, and a time of one second a record."""
    from ..functions.numbers import binary_label
    from ..sources.synthetic import seconds_from

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = seconds_from(F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.col("event_id"))
    return events.select("event_id", binary_label(F.concat("event_type", F.lit(".")), "view.").cast("long").alias("label"), F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("time"))


@query(None)
def synthetic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.synthetic import random_strings, random_words

    words = [r["word"] for r in random_strings(spark, 20, 6, 1).collect()]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", random_words(F.col("event_id"), words).alias("text"))
