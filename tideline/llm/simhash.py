"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, text_of, text_tag
from .components import connected_components

#: Words per shingle, bytes of a fingerprint, bits that may differ between linked fingerprints.
WORDS, BYTES, BITS = 3, 8, 3
#: d differing bits lie in at most d bytes, so a linked pair shares at least this many positional bytes.
SHARED = BYTES - BITS
#: Posting lists are keyed by three bytes and their positions, all in one half of the fingerprint: of the BITS bytes that may
#: differ one half has at most one, so every linked pair meets in a list of that half.
POSTINGS = [sum(0xFF << 8 * i for i in at) for half in (range(4), range(4, 8)) for at in combinations(half, 3)]
#: A list of more fingerprints is split: its members are posted by every choice of SHARED positions instead.
LONG_LIST = 8192
LONG_POSTINGS = [sum(0xFF << 8 * i for i in at) for at in combinations(range(BYTES), SHARED)]
_CHUNK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words, in lists of about 4 MB that repeat the last words of the list before."""
    start, last = 0, []
    while start < len(text):
        end = start + _CHUNK
        if end < len(text):
            end = m.start() if (m := _SPACE.search(text, end)) else len(text)
        words = last + text[start:end].lower().split()
        yield words
        last, start = words[-(WORDS - 1):], end


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of UTF-8 ``text``, as a signed integer; 0 without words."""
    counts, n, short = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _pieces(text):
        short = words
        if len(words) >= WORDS:
            hashes = np.array([digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(WORDS))))], "<u8")
            for k in range(0, len(hashes), 1 << 16):
                part = hashes[k : k + (1 << 16)]
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
    if not n:
        if not short:
            return 0
        return int(np.uint64(digest(b" ".join(short), 42)).view(np.int64))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        prints = pa.array([fingerprint(t.as_buffer().to_pybytes()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), prints], ["doc_id", "tag", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, fp) for each row of ``docs``; a null text counts as empty and has fingerprint 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_tag().alias("tag"), text_of().alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, tag long, fp long")


def _linked(differing: np.ndarray) -> np.ndarray:
    """Which pairs are linked, from the exclusive or of their fingerprints: tally the bytes they share by position, keep
    those that reach the guaranteed count, verify these bit by bit."""
    tally = (differing.reshape(-1, 1).view(np.uint8) == 0).sum(1)
    kept = np.flatnonzero(tally >= SHARED)
    out = np.zeros(differing.size, bool)
    out[kept] = np.bitwise_count(differing.ravel()[kept]) <= BITS
    return out.reshape(differing.shape)


def spanning_links(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, never all pairs.

    Breadth first: each visited value is compared with those not yet reached. Beyond 4096 values, its
    neighbours within BITS bits of the bytes that are free are looked up instead, so time stays linear.
    """
    values = np.unique(values.astype(np.uint64))
    out: list[tuple[int, int]] = []
    if len(values) <= 64 and _linked(values[:, None] ^ values[None, :]).sum() == len(values):
        return out  # each with itself only
    free = int(np.bitwise_or.reduce(values ^ values[0])) if len(values) else 0
    bits = [1 << i for i in range(64) if free >> i & 1]
    by_mask = len(values) > 4096 and len(bits) <= 8 * BITS
    masks = np.array([sum(c) for r in range(1, BITS + 1) for c in combinations(bits, r)], np.uint64) if by_mask else None
    open_, queue = np.ones(len(values), bool), []
    left = np.arange(len(values))
    for start in range(len(values)):
        if not open_[start]:
            continue
        open_[start] = False
        queue.append(start)
        while queue:
            at = queue.pop()
            if by_mask:
                near = values[at] ^ masks
                where = np.searchsorted(values, near).clip(max=len(values) - 1)
                where = where[(values[where] == near) & open_[where]]
            else:
                left = left[open_[left]]
                where = left[_linked(values[left] ^ values[at])]
            open_[where] = False
            queue.extend(where.tolist())
            out.extend((int(values[at].view(np.int64)), int(x)) for x in values[where].view(np.int64))
    return out


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; the rows come sorted by key. A run holds at most 2**24 fingerprints."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(k)]
        many = np.flatnonzero(ends - starts >= 2)
        found = [x for i in many for x in spanning_links(p[starts[i] : ends[i]].view(np.uint64))]
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keys, prints = np.r_[keys, batch.column(0).to_numpy()], np.r_[prints, batch.column(1).to_numpy()]
        if len(keys) and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield links(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield links(keys, prints)


def _posted(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(key, fp): each fingerprint in the posting lists of ``masks``."""
    some = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    rows = prints.select("fp", F.posexplode(some).alias("at", "mask"))
    return rows.select(F.xxhash64("at", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")


def _links_of_lists(posted: DataFrame) -> DataFrame:
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(_link_batches, "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect what all pairs of fingerprints within BITS bits connect.

    ``prints`` has distinct ``fp``. A pair within BITS bits shares SHARED of its BYTES positional bytes at least.
    Lists of single bytes would hold a 256th of all fingerprints each, so postings are by three bytes. In each
    list the shared positional bytes of its pairs are tallied, pairs that reach SHARED are kept and verified, and
    a spanning forest comes out, at most the list's length less one. Fingerprints of a list longer than LONG_LIST
    are posted by SHARED bytes instead, which spreads them and still lets every linked pair meet.
    """
    posted = _posted(prints, POSTINGS)
    long_ = materialize(posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LONG_LIST).select("key"))
    if long_.isEmpty():
        return _links_of_lists(posted)
    long_ = checked_broadcast(long_)
    crowd = posted.join(long_, "key", "left_semi").select("fp").distinct()
    return _links_of_lists(posted.join(long_, "key", "left_anti")).union(_links_of_lists(_posted(crowd, LONG_POSTINGS)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over links, the row's own included (null ids count only if
    there is no other). Rows with equal fingerprints are linked, and so are texts without words. Repeated rows
    stay repeated; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs))
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(firsts.select("fp")))
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", "tag", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id.

    Null ids come last; ties between rows of one doc_id go to the smaller content tag; of wholly repeated
    rows one stays.
    """
    found = materialize(near_duplicates(docs))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("best")
    by_print = found.groupBy("fp", "component_id").agg(best)
    keep = by_print.where("component_id is not null").groupBy("component_id").agg(F.min("best").alias("best")).select("best.*")
    nameless = found.where("component_id is null")
    if not nameless.isEmpty():
        rooted = by_print.where("component_id is null").join(_roots_without_id(nameless), "fp")
        keep = keep.union(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.*"))
    keep = keep.select(F.col("doc_id").alias("__kept_id"), F.col("tag").alias("__kept_tag"))
    same = docs["doc_id"].eqNullSafe(keep["__kept_id"]) & (F.xxhash64(docs["text"]) == keep["__kept_tag"])
    first = F.expr("row_number() over (partition by __kept_id, __kept_tag order by 1)")
    return docs.join(keep, same).withColumn("__kept_n", first).where("__kept_n = 1").select(*docs.columns)


def _roots_without_id(nameless: DataFrame) -> DataFrame:
    """(fp, root) of the fingerprints whose components have no doc_id at all."""
    prints = nameless.select("fp").distinct()
    roots = connected_components(links(prints))
    return prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
