"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, text_of, text_tag

#: (kind, pattern, group that holds the secret, least length of that group).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Further candidates: long mixed tokens. They count as secrets only if few owners have them.
MIXED, MIXED_LEAST = r"[A-Za-z0-9+/_-]+", 20
#: A value that so many owners or more have is a copied example.
EXAMPLE_OWNERS = 3
#: Matches of a text whose lengths are summed at a time.
_BLOCK = 512

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,hash:bigint>>"


def _prefix_sums(lengths: Column) -> Column:
    """Exclusive prefix sums of an array, in blocks: a fold that appends copies its array in each step."""
    empty = F.array().cast("array<bigint>")
    fold = lambda xs, start: F.aggregate(
        xs, F.struct(start.alias("sum"), empty.alias("out")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"],
    )
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, fold(sums, zero), lambda b, at: fold(b, at)))


def _matches(rows: DataFrame, name: str, pattern: str, group: int) -> DataFrame:
    """``rows`` with ``name``: an array of (start, end, value) of the leftmost non-overlapping matches, in code points.

    The matches themselves and the gaps between them add up to the text, so their lengths give the places.
    """
    found, gaps = f"__{name}_found", f"__{name}_gaps"
    rows = rows.withColumn(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size(found) > 0
    rows = rows.withColumn(gaps, F.when(some, F.transform(F.split("text", pattern, -1), lambda g: F.char_length(g).cast("bigint"))))
    sizes = F.transform(F.col(found), lambda m: F.char_length(m).cast("bigint"))
    rows = rows.withColumn(f"__{name}_at", F.when(some, _prefix_sums(F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(found)), sizes, lambda g, m: g + m))))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.col(found)
    rows = rows.withColumn(f"__{name}_values", F.when(some, values))
    made = F.transform(F.col(found), lambda m, i: F.struct(
        (F.get(f"__{name}_at", i) + F.get(gaps, i)).alias("start"),
        (F.get(f"__{name}_at", i) + F.get(gaps, i) + F.char_length(m)).alias("end"),
        F.get(f"__{name}_values", i).alias("value")))
    return rows.withColumn(name, F.when(some, made).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))).drop(found, gaps, f"__{name}_at", f"__{name}_values")


def _long_enough(least: int):
    return lambda m: F.char_length(m["value"]) >= least


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.xxhash64(m["value"]).alias("hash")))


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, tag, owner, base, mixed) of each row: spans (start, kind, end, hash) of base and further candidates.

    ``kind`` is the position in BASE, or len(BASE). Spans of ``base`` are in order of start, then kind. Further
    candidates hold an upper-case and a lower-case letter and a digit, and don't overlap a base span.
    """
    rows = docs.select("doc_id", text_tag().alias("tag"), F.col(owner).alias("owner"), text_of().alias("text"))
    spans = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        # a run of the class is one match either way, so the least length can be part of the pattern
        rows = _matches(rows, name, pattern if group else pattern[:-1] + f"{{{least - len('AKIA') * (name == 'access')},}}", group)
        spans.append(_spans(F.filter(name, _long_enough(least)), k))
    rows = _matches(rows, "mixed", MIXED[:-1] + f"{{{MIXED_LEAST},}}", 0)
    rows = rows.withColumn("base", F.array_sort(F.concat(*spans)))
    lively = lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]")
    free = F.filter(F.filter("mixed", lively), lambda m: ~F.exists(F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select("doc_id", "tag", "owner", F.col("base").cast(_SPANS).alias("base"), _spans(free, len(BASE)).cast(_SPANS).alias("mixed"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_docs) of each candidate value: its distinct owners and documents over the corpus."""
    hashes = F.array_distinct(F.transform(F.concat("base", "mixed"), lambda s: s["hash"]))
    rows = found.select("owner", "doc_id", F.explode_outer(hashes).alias("hash")).where("hash is not null").distinct()
    by_owner = rows.groupBy("hash", "owner").agg(F.count("*").alias("n_docs"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n_docs").alias("n_docs"))


def scan(docs: DataFrame, owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, tag, spans, n_example, n_live) for each row of ``docs``; spans of (start, kind, end, hash, owners).

    All base spans stay. A further candidate is kept if fewer than ``example_owners`` owners have its value
    anywhere in the corpus. ``n_example`` counts kept spans whose value is a copied example, ``n_live`` those
    whose value belongs to few owners. A null text is empty; a null owner is an owner; repeated rows stay; an
    empty table gives no rows.
    """
    found = materialize(candidates(docs, owner).withColumn("row", F.monotonically_increasing_id()))
    owned = ownership(found)
    spans = found.select("row", F.explode_outer(F.concat("base", "mixed")).alias("s")).where("s is not null")
    placed = spans.join(owned, spans["s.hash"] == owned["hash"], "left").where((F.col("s.kind") < len(BASE)) | (F.col("n_owners") < example_owners))
    placed = placed.select("row", F.struct("s.start", "s.kind", "s.end", "s.hash", F.col("n_owners").alias("owners")).alias("s"))
    by_row = placed.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    rows = found.select("doc_id", "tag", "row").join(by_row, "row", "left")
    spans_or_none = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:bigint,owners:bigint>>"))
    rows = rows.select("doc_id", "tag", spans_or_none.alias("spans"))
    example = F.size(F.filter("spans", lambda s: s["owners"] >= example_owners)).cast("long")
    return rows.select("doc_id", "tag", "spans", example.alias("n_example"), (F.size("spans").cast("long") - example).alias("n_live"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(b[0]) for b in BASE], F.lit("owned"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live) for each row of ``docs``."""
    rows = scan(docs, owner)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [n(k).alias(f"n_{b[0]}") for k, b in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), "n_example", "n_live")


def redact(docs: DataFrame, owner: str = "source", mask: str = "[secret]") -> DataFrame:
    """``docs`` with each run of secret spans in ``text`` replaced by ``mask``, and ``n_chars`` to match if present.

    Copied examples that only the ownership method would add stay as they are.
    """
    found = scan(docs, owner).where(F.size("spans") > 0).dropDuplicates(["doc_id", "tag"])
    spans = materialize(found.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("__spans")))
    rows = docs.join(checked_broadcast(spans, weight=F.size("__spans")), docs["doc_id"].eqNullSafe(spans["__id"]) & (F.xxhash64(docs["text"]) == spans["__tag"]), "left")
    zero = F.lit(0).cast("bigint")
    cut = F.aggregate(
        "__spans", F.struct(zero.alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] < a["at"]) | ((s["start"] == a["at"]) & (a["at"] > 0)), a["out"])
            .otherwise(F.concat(a["out"], F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask)))).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text"))),
    )
    rows = rows.withColumn("__cut", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut))
    out = [F.col("__cut").alias(c) if c == "text" else docs[c] for c in docs.columns]
    if "n_chars" in docs.columns:
        length = F.when(F.col("__spans").isNull(), docs["n_chars"]).otherwise(F.char_length("__cut")).cast(docs.schema["n_chars"].dataType)
        out = [length.alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, out)]
    return rows.select(*out)
