"""Turning tables into record streams: codes, flags, explode-union, vocabularies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize
from .prefix import dense_numbers

#: Rows of texts that meet their part of the vocabulary in one task.
DOC_BLOCK = 512


def first_seen_codes(df: DataFrame, value: str, seq: str, start: int = 1) -> DataFrame:
    """(value, code): values numbered in the order in which they first occur; code 0 stays free for what is missing."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(seq).alias("first"))
    return dense_numbers(firsts, ["first", value], "code").select(value, (F.col("code") + start).alias("code"))


def ignore_flags(df: DataFrame, key: str, seq: str) -> DataFrame:
    """``df`` with ``ignore``: 0 on the first row of each key, else 1."""
    return df.withColumn("ignore", (F.row_number().over(Window.partitionBy(key).orderBy(seq)) > 1).cast("int"))


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def explode_union(df: DataFrame, keep: list[str], aspects: dict[str, Column]) -> DataFrame:
    """One aspect a row: each aspect's array exploded in turn, the other aspects null; an empty array gives one null row.

    ``aspects``: name -> array column. Adds ``aspect`` (rank of the aspect) and ``position``, so that
    (keep, aspect, position) is a total order.
    """
    parts = []
    for rank, (name, array) in enumerate(aspects.items()):
        rows = df.select(*keep, F.lit(rank).alias("aspect"), F.posexplode_outer(array).alias("position", name))
        parts.append(rows.select(*keep, "aspect", "position", *[F.col(n) if n == name else F.lit(None).cast("string").alias(n) for n in aspects]))
    return reduce(DataFrame.unionByName, parts)


def suppress_repeated_text(df: DataFrame, id_: str, original: str, text: str, seq: str) -> DataFrame:
    """``df`` with the text of a repost blank if the original or another repost came before; originals stay."""
    rn = F.row_number().over(Window.partitionBy(F.coalesce(original, id_)).orderBy(seq))
    rows = df.withColumn("__rn", rn)
    return rows.withColumn(text, F.when(F.col(original).isNotNull() & (F.col("__rn") > 1), F.lit("")).otherwise(F.col(text))).drop("__rn")


def vocabulary(tokens: DataFrame, token: str, seq: str) -> DataFrame:
    """(token, occurrences, idx): tokens numbered from 0 by first occurrence."""
    counts = tokens.groupBy(token).agg(F.count("*").alias("occurrences"), F.min(seq).alias("first"))
    return dense_numbers(counts, ["first", token], "idx").select(token, "occurrences", "idx")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all), those whose salted key has the smallest MD5."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, those whose salted key has a small MD5: the same rows whatever the partitioning."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(head < F.lit(int(fraction * (1 << 32))))


def _blocked(docs: DataFrame, id_: str, tokens: Column) -> DataFrame:
    """(id, words, block): rows that have words, in blocks of about DOC_BLOCK by a hash."""
    rows = docs.select(F.col(id_).alias("id"), tokens.alias("words"), F.pmod(F.xxhash64(id_), F.lit(max(1, -(-docs.count() // DOC_BLOCK)))).alias("block"))
    return materialize(rows).where(F.size("words") > 0)  # filtered once written, else the words are made twice


def _met(blocked: DataFrame) -> DataFrame:
    """(block, token, occurrences, first): the words of each block, first by id and place; one row a word and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        words = t["words"].combine_chunks()
        codes = words.flatten().dictionary_encode()
        sizes, at = pc.list_value_length(words).to_numpy(zero_copy_only=False), codes.indices.to_numpy(zero_copy_only=False)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.full(len(codes.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, at, np.repeat(t["id"].to_numpy() * (1 << 32), sizes) + pos)
        n = np.bincount(at, minlength=len(first))
        yield pa.RecordBatch.from_arrays([pa.repeat(t["block"][0], len(first)), codes.dictionary, pa.array(n, pa.int64()), pa.array(first)], ["block", "token", "occurrences", "first"])

    return materialize(blocked.groupBy("block").applyInArrow(run, "block long, token string, occurrences long, first long"))


def _numbered(met: DataFrame) -> DataFrame:
    counts = met.groupBy("token").agg(F.min("first").alias("first"))
    return met.select("block", "token").join(dense_numbers(counts, ["first", "token"], "idx").select("token", "idx"), "token")


def token_lists(docs: DataFrame, id_: str, tokens: Column) -> DataFrame:
    """(id, indices): each row's tokens as numbers from 0 by first occurrence in the table, in order, by spaces; none for no tokens.

    Only a block's distinct words are joined with the vocabulary; a block and its part of the vocabulary meet in a task.
    """
    blocked = _blocked(docs, id_, tokens)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = left["words"].combine_chunks()
        numbers = right["idx"].combine_chunks().cast(pa.string()).take(pc.index_in(words.flatten(), value_set=right["token"].combine_chunks()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(words))]), pa.int32()), numbers)
        return pa.table({"id": left["id"], "indices": pc.binary_join(lists, " ")})

    return blocked.groupBy("block").cogroup(_numbered(_met(blocked)).groupBy("block")).applyInArrow(run, "id long, indices string")


def embedded_tokens(docs: DataFrame, id_: str, tokens: Column, vectors: DataFrame) -> DataFrame:
    """(id, pos, token, idx, vec): the tokens of each row that ``vectors`` (word, vec) knows, in order, numbered from 0 by
    first occurrence among the known ones; words without a vector are left out. Blocks meet their words as in token_lists.
    """
    blocked = _blocked(docs, id_, tokens)
    vectors = vectors.select(F.col("word").alias("token"), "vec")
    met = materialize(_met(blocked).join(vectors, "token"))
    known = _numbered(met).join(vectors, "token")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = left["words"].combine_chunks()
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = words.flatten()
        found = pc.index_in(flat, value_set=right["token"].combine_chunks())
        has = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        found = found.take(pa.array(has))
        return pa.table({"id": left["id"].take(pa.array(row[has])), "pos": pa.array(pos[has], pa.int32()), "token": flat.take(pa.array(has)), "idx": right["idx"].take(found), "vec": right["vec"].take(found)})

    kind = vectors.schema["vec"].dataType.simpleString()
    return blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"id long, pos int, token string, idx long, vec {kind}")


def chunked(df: DataFrame, seq: str, size: int) -> DataFrame:
    """``df`` with ``chunk``: consecutive groups of ``size`` rows, for numbers from 0."""
    return df.withColumn("chunk", F.floor(F.col(seq) / F.lit(size)).cast("long"))
