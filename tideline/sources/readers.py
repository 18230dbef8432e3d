"""Readers of record streams, nested posts, typed headers, word vectors and score files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST = (
    "id string, text string, created_at string, author_id string, in_reply_to_user_id string, "
    "entities struct<hashtags:array<struct<tag:string>>,mentions:array<struct<username:string>>>, "
    "public_metrics struct<retweet_count:bigint,quote_count:bigint,reply_count:bigint,like_count:bigint>, "
    "referenced_tweets array<struct<type:string,id:string>>"
)
REFERENCES = ("retweeted", "quoted", "replied_to")


def _reference(kind: str) -> Column:
    """The id of the last reference of a kind, null without one."""
    ids = F.filter("referenced_tweets", lambda r: r["type"] == kind)
    return F.try_element_at(ids, F.lit(-1))["id"]


def flat_posts(posts: DataFrame) -> DataFrame:
    """One row a post from parsed POST rows: nested fields projected, missing lists empty, references as columns."""
    names = lambda c, f: F.coalesce(F.transform(F.col(c), lambda x: x[f]), F.array().cast("array<string>"))
    metrics = ("retweet_count", "quote_count", "reply_count", "like_count")
    return posts.select(
        "id", "text", F.to_timestamp("created_at").alias("created_at"), F.col("author_id").alias("user_id"), "in_reply_to_user_id",
        names("entities.hashtags", "tag").alias("hashtags"), names("entities.mentions", "username").alias("mentions"),
        *[F.col(f"public_metrics.{m}").alias(m) for m in metrics], *[_reference(k).alias(k) for k in REFERENCES],
    )


def nested_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of response files ``{"data": [...]}``, one document a file."""
    files = spark.read.schema(f"data array<struct<{POST}>>").json(path, multiLine=True)
    return flat_posts(files.select(F.explode("data").alias("p")).select("p.*"))


def record_posts(spark: SparkSession, path: str) -> DataFrame:
    """Flat post records: epoch-millisecond times, the text None as null, lists in lower case, no counts for reposts."""
    schema = "id string, user_id string, text string, created_at bigint, hashtags array<string>, mentions array<string>, retweet_count bigint, quote_count bigint, reply_count bigint, like_count bigint, retweeted string, quoted string, replied_to string"
    rows = spark.read.schema(schema).json(path)
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("None")) for c in REFERENCES})
    rows = rows.withColumns({c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower) for c in ("hashtags", "mentions")})
    return rows.withColumns({"created_at": F.timestamp_millis("created_at"), "retweet_count": F.when(F.col("retweeted").isNull(), F.col("retweet_count")).otherwise(0)})


def headerless_csv(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Comma-separated values without a header, lines that begin with # left out; strict fails on what doesn't parse."""
    return spark.read.csv(path, schema=schema, header=False, comment="#", mode="FAILFAST" if strict else "PERMISSIVE")


def headed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None)


def typed_schema(header: str) -> T.StructType:
    """The schema that lines ``name: continuous.`` or ``name: symbolic.`` describe; a last column ``label``."""
    fields = []
    for line in header.splitlines():
        if m := re.match(r"\s*([^:]+):\s*(\w+)\.?\s*$", line):
            fields.append(T.StructField(m[1].strip(), T.DoubleType() if m[2] == "continuous" else T.StringType()))
    return T.StructType([*fields, T.StructField("label", T.StringType())])


def word_vectors(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(word, vec) from lines (n, value) of a word-vector text file: line 0 is its header; the first ``limit`` words."""
    rows = lines.where((F.col("n") > 0) & (F.lit(limit is None) | (F.col("n") <= (limit or 0))))
    parts = F.split(F.rtrim("value"), " ")
    return rows.select(parts[0].alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.cast("float")).alias("vec"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of text files with their numbers from 0, in order of file and place.

    Files are split among tasks as Spark likes. Lines are counted by file and split, only these counts are scanned
    in order, and a line's place within its split is added.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    split = ["file", "block"]
    counts = rows.groupBy(*split).agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in split], "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    rows = rows.join(starts, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    # ids of a split's lines are consecutive, since one task reads them one after the other
    return rows.select((F.col("start") + F.col("at") - F.col("first")).cast("long").alias("n"), "value")


def number_lists(lines: DataFrame) -> DataFrame:
    """(n, values): the numbers of comma-separated lines (n, value). Lines that begin with # are left out, and so is
    what does not parse, which shortens its row; rows keep the numbers of their lines.
    """
    kept = lines.where(~F.startswith("value", F.lit("#")))
    parsed = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    return kept.select("n", F.array_compact(parsed).alias("values"))


def bucket_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(feature, file, value): lines of bucket files, the feature taken from the file's name."""
    rows = spark.read.text(pattern).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", r"buckets_([a-z]+)_score", 1).alias("feature"), "file", "value")


def record_stream(df: DataFrame, numeric: list[str], categorical: list[str], time: str, order: list[str], id_: str | None = None) -> DataFrame:
    """A record stream (seq, t, features, perhaps id and ignore) of ``df`` in the total order given.

    Numbers are given in two levels: rows are counted by range of the first order column, then numbered inside.
    """
    from ..operators.encode import ignore_flags
    from ..operators.prefix import dense_numbers

    rows = dense_numbers(df, order).withColumn("t", F.col(time).cast("long"))
    rows = rows.select("seq", "t", *numeric, *categorical, *([F.col(id_).alias("id")] if id_ else []))
    return ignore_flags(rows, "id", "seq") if id_ else rows
