"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Lengths of the n-grams, hash buckets, additive smoothing.
GRAMS, BUCKETS, SMOOTHING = (1, 2, 3, 4), 1 << 15, 0.5
#: About so many labelled rows for each language are learned from, chosen by a hash of their ids.
TRAIN_ROWS = 4000
#: Languages a model may have: the matrix that is broadcast has LANGUAGES * BUCKETS floats at most.
LANGUAGES = 2000
#: Code points that are held at a time.
RUN = 1 << 19
#: A document whose best language has a smaller posterior is rejected.
LEAST_SCORE = 0.5
#: So is one whose mean log-likelihood an n-gram lies this far below that of all but a share of its language's training
#: rows; a text of few n-grams may lie SLACK divided by their number further below.
OUTLIERS, MARGIN, SLACK = 0.001, 1.5, 20.0

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _tokens(points: np.ndarray) -> np.ndarray:
    """Letters in lower case; each run of anything else is one 0."""
    mapped = _letters()[points]
    return mapped[(mapped != 0) | np.r_[True, mapped[:-1] != 0]] if len(mapped) else mapped


def _buckets(tokens: np.ndarray) -> list[np.ndarray]:
    """For each n-gram length the bucket of the n-gram that starts at each token."""
    out = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(tokens) < n:
                out.append(np.empty(0, np.uint32))
                continue
            h = np.full(len(tokens) - n + 1, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ tokens[j : len(tokens) - n + 1 + j]) * _FACTORS[j]
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(BUCKETS - 1))
    return out


def _runs(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(overlap, tokens): runs of the tokens of ``text``, each beginning with the last few of the run before."""
    rest, overlap = np.zeros(1, np.uint32), 0
    for k in range(0, max(len(text), 1), RUN):
        tokens = _tokens(np.frombuffer(text[k : k + RUN].encode("utf-32-le", "surrogatepass"), np.uint32))
        if len(tokens) and rest[-1] == 0 and tokens[0] == 0:
            tokens = tokens[1:]
        tokens = np.r_[rest, tokens]
        yield overlap, tokens
        rest = tokens[-(max(GRAMS) - 1):]
        overlap = len(rest)


def counted(text: str) -> tuple[np.ndarray, bool]:
    """Bucket counts of a whole text, and whether it has a letter."""
    total, letters = np.zeros(BUCKETS, np.int64), False
    for overlap, tokens in _runs(text):
        letters |= bool(tokens.any())
        for n, h in zip(GRAMS, _buckets(tokens)):
            total += np.bincount(h[max(0, overlap - n + 1):], minlength=BUCKETS)
    return total, letters


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # buckets x languages
    priors: np.ndarray


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            counts, _ = counted(text.as_py())
            sums[lang] = sums.get(lang, 0) + counts
            rows[lang] = rows.get(lang, 0) + 1
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[rows[lang], counts[at]])], ["lang", "bucket", "n"]
        )


def _chosen(docs: DataFrame, train_rows: int) -> tuple[dict[str, int], DataFrame] | None:
    """Number of labelled rows by language, and those of them that are learned from."""
    labelled = docs.where("lang is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_rows / n))]), F.col("lang"))
    picked = labelled.where((F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) / 1e6) < share)
    return sizes, picked


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from rows of ``docs`` with a non-null lang; the caller leaves out what is held out.

    About ``train_rows`` rows of each language are used, those whose hashed doc_id falls below a threshold;
    a language with fewer is used whole. Counts meet per (language, bucket) before they reach the driver.
    None if there is no labelled row.
    """
    chosen = _chosen(docs, train_rows)
    if not chosen:
        return None
    sizes, picked = chosen
    counts = picked.select("lang", text_of().alias("text")).mapInArrow(_count_batches, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    if not languages:
        return None
    matrix, rows = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    at = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    matrix[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    rows[at[bucket < 0]] = n[bucket < 0]
    smooth = matrix + SMOOTHING
    total = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(smooth / smooth.sum(0)), np.log(total / total.sum()))


def _scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log posteriors (unnormalised) of each text, whether it has a letter and its number of n-grams; many short texts at a time."""
    out, letters, grams = np.tile(model.priors, (len(texts), 1)), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= RUN):
            size += len(texts[end])
            end += 1
        if end == start + 1:
            counts, letters[start] = counted(texts[start])
            at = np.flatnonzero(counts)
            out[start] += counts[at] @ model.logs[at]
            grams[start] = counts.sum()
        else:
            _score_run(texts[start:end], model, out[start:end], letters[start:end], grams[start:end])
        start = end
    return out, letters, grams


def _score_run(texts: list[str], model: Model, out: np.ndarray, letters: np.ndarray, grams: np.ndarray) -> None:
    parts = []
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        tokens = _tokens(points)
        parts.append(np.r_[np.zeros(1, np.uint32), tokens[1:] if len(tokens) and tokens[0] == 0 else tokens])
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(parts)), sizes)
    tokens = np.concatenate(parts)
    letters |= np.bincount(row, tokens != 0, len(parts)) > 0
    grams += sum(np.maximum(sizes - n + 1, 0) for n in GRAMS)
    for n, h in zip(GRAMS, _buckets(tokens)):
        inside = np.arange(len(h)) + n <= np.repeat(ends, sizes)[: len(h)]  # no n-gram across two texts
        pairs = row[: len(h)][inside] * np.int64(BUCKETS) + h[inside]
        cells, times = np.unique(pairs, return_counts=True)
        r, b = np.divmod(cells, BUCKETS)
        for k in range(len(model.languages)):
            out[:, k] += np.bincount(r, times * model.logs[b, k], len(parts))


def predict(docs: DataFrame, model: Model | None, likelihood: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``, the posterior of the predicted language (0 to 1).

    Only the whole text is looked at. Null texts, texts without a letter and all texts under no model are
    ``und`` with score 0. ``likelihood`` adds the mean log-likelihood of the n-grams in that language, and their number ``grams``. Ties go to the language first in order. Repeated rows stay; an empty table is empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep, added = docs.columns, ["likelihood", "grams"] if likelihood else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if model is None:
                names, best, mean, grams = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            else:
                logs, letters, grams = _scores(texts, model)
                top = logs.argmax(1)
                mean = (logs.max(1) - model.priors[top]) / np.maximum(grams, 1)
                best = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                names = [model.languages[k] if ok else "und" for k, ok in zip(top, letters)]
                best = np.where(letters, best, 0.0)
            more = [pa.array(mean), pa.array(grams)] if likelihood else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best), *more], [*batch.schema.names, "lang_pred", "score", *added])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double", *(f"{c} {t}" for c, t in zip(added, ("double", "long")))]))


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: crc32 of doc_id as text is divisible by 5 (a null doc_id counts as empty text)."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learned from the rows that are not held out."""
    model = fit(held_out(docs.select("doc_id", "lang", "text")).where("not held_out"))
    return held_out(predict(docs.select("doc_id", "text"), model)).select("doc_id", "held_out", "lang_pred", "score")


def recognised(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: with a posterior of at least ``least``, and as likely as its texts are.

    The posterior only compares the languages learned; a text in none of them is found by its likelihood in the
    best of them, which ``_floors`` calibrates. Without a labelled row to learn from no language can be told from
    another: all rows with a letter stay.
    """
    learned = held_out(docs.select("doc_id", "lang", "text")).where("not held_out")
    model = fit(learned)
    floors = _floors(learned, model) if model else {}
    keep = [F.col(c) for c in docs.columns]
    scored = predict(docs.select(F.struct(*keep).alias("__row"), F.col("text")), model or Model(("any",), np.zeros((BUCKETS, 1)), np.zeros(1)), likelihood=True)
    scored = scored.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    if floors:
        floor = F.element_at(F.create_map(*[F.lit(x) for pair in floors.items() for x in pair]), F.col("lang_pred"))
        scored = scored.where(F.coalesce(F.col("likelihood") >= floor - MARGIN - F.lit(SLACK) / F.col("grams"), F.lit(True)))
    return scored.select("__row.*")


def _floors(learned: DataFrame, model: Model, train_rows: int = TRAIN_ROWS) -> dict[str, float]:
    """By language: the mean log-likelihood an n-gram that all but OUTLIERS of the training rows taken for it reach."""
    _, picked = _chosen(learned, train_rows)
    scored = predict(picked.select("text"), model, likelihood=True).where("lang_pred <> 'und'")
    return {r["lang_pred"]: r["floor"] for r in scored.groupBy("lang_pred").agg(F.percentile_approx("likelihood", OUTLIERS, 10_000).alias("floor")).collect()}
