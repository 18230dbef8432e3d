"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, string_weight, text_of, text_tag

WORDS, CONTAINMENT = 5, 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _at(i: Column) -> list[Column]:
    return [F.get("words", i + j) for j in range(WORDS)]


def shingle_hashes(df: DataFrame) -> DataFrame:
    """``words`` replaced by ``hashes``, one for each shingle; fewer than WORDS words are one shingle, none give none."""
    n = F.size("words")
    hashed = (
        F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*_at(i))))
        .when(n > 0, F.array(F.xxhash64(F.array_join("words", " "), F.lit(WORDS))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return df.withColumn("hashes", hashed).drop("words")


def shingles(df: DataFrame) -> DataFrame:
    """``words`` replaced by ``shingles``, the distinct shingles as strings."""
    n = F.size("words")
    made = (
        F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.concat_ws(" ", *_at(i))))
        .when(n > 0, F.array(F.array_join("words", " ")))
        .otherwise(F.array().cast("array<string>"))
    )
    return df.withColumn("shingles", F.array_distinct(made)).drop("words")


def _sketch_length(size: Column, threshold: float) -> Column:
    """Shingles of an item of ``size`` that may be missing, and one more: one of so many is in any match."""
    return (size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def sketches(benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """(item_id, hash): the smallest shingle hashes of each item.

    Items are partitioned by size into powers of two. Within a partition whose items have at most u shingles,
    the sketch is the bottom-m MinHash with m = u - ceil(threshold * u) + 1. A document that contains the
    threshold's share of an item lacks fewer than m of its shingles, so it holds one of the sketch: nothing is
    missed, however long the document is.
    """
    items = shingle_hashes(benchmark.select("item_id", words(text_of()).alias("words")))
    items = items.select("item_id", F.array_sort(F.array_distinct("hashes")).alias("hashes")).where(F.size("hashes") > 0)
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes")))).cast("int")
    return items.select("item_id", F.explode_outer(F.slice("hashes", 1, _sketch_length(upper, threshold))).alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, tag, item_id, n_shared, n_item) for rows of ``docs`` with at least ``threshold`` of an item's shingles.

    Every shingle of every document probes the sketches; what is found is verified on the strings of the
    shingles themselves. Null or wordless texts match nothing; an item of fewer than WORDS words matches a
    document that consists of it. Rows equal in doc_id and text are reported once; an empty table on either
    side gives no rows.
    """
    probe = checked_broadcast(sketches(benchmark, threshold))
    hashed = shingle_hashes(docs.select("doc_id", text_tag().alias("tag"), words(text_of()).alias("words")))
    found = hashed.select("doc_id", "tag", F.explode_outer("hashes").alias("hash")).join(probe, "hash")
    pairs = materialize(found.select("doc_id", "tag", "item_id").distinct())
    keys = pairs.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    near = docs.select("doc_id", "text").withColumn("tag", text_tag())
    near = near.join(checked_broadcast(keys), near["doc_id"].eqNullSafe(F.col("__id")) & (near["tag"] == F.col("__tag")), "left_semi")
    said = shingles(near.dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", words(text_of()).alias("words")))
    said = said.select("doc_id", "tag", F.explode_outer("shingles").alias("shingle"))
    items = shingles(benchmark.select("item_id", words(text_of()).alias("words")).distinct())
    items = items.select("item_id", F.size("shingles").alias("n_item"), F.explode_outer("shingles").alias("shingle"))
    shared = said.join(checked_broadcast(items, weight=string_weight("shingle")), "shingle").groupBy("doc_id", "tag", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    a, b = shared.alias("a"), pairs.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tag") == F.col("b.tag")) & F.col("a.item_id").eqNullSafe(F.col("b.item_id"))
    return a.join(b, same, "left_semi").where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, all columns kept."""
    hits = materialize(contained(docs, benchmark, threshold).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct())
    same = docs["doc_id"].eqNullSafe(hits["__id"]) & (F.xxhash64(docs["text"]) == hits["__tag"])
    return docs.join(checked_broadcast(hits), same, "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment), the best row of a doc_id for each item."""
    best = contained(docs, benchmark, threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_shared").alias("n_shared"), F.col("best.n_item").cast("long").alias("n_item"), F.round("best.c", 6).alias("containment"))


_SHINGLES = """
    select {id}, unnest(list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s
    from (select distinct {id}, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as w from {table})
"""
ORACLE_SQL = f"""
with d as ({_SHINGLES.format(id="doc_id", table="documents")}), i as ({_SHINGLES.format(id="item_id", table="benchmark")}),
n as (select item_id, count(*) as n_item from i group by item_id)
select doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) as containment
from (select doc_id, item_id, count(*) as n_shared from d join i using (s) group by doc_id, item_id) join n using (item_id)
where n_shared * 10 >= n_item * 8
"""
