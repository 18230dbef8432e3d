"""Nearest neighbours by additive quantisation in a coarse partition, with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Codebooks, words of each, beams kept while a vector is encoded.
BOOKS, CODES, BEAM = 16, 256, 4
#: Vectors that the codebooks are fitted on at most, chosen by a hash of their ids; all are indexed.
FIT_ROWS, FIT_ROUNDS = 8192, 8
#: Queries that are broadcast at a time, and vectors scored at a time.
QUERY_BLOCK, ROW_BLOCK = 2048, 2048
#: Candidates of each block of rows that are scored first, only to find how good the k-th best is at least.
SHORTLIST = 64
#: Share of a block's pairs of query and row above which all of them are scored by one product of matrices.
DENSE = 0.02
#: Scores that agree to so many parts of one are a tie.
TIE = 1e12


@dataclass(frozen=True)
class Books:
    words: np.ndarray  # BOOKS x CODES x dimension, full-dimensional

    @property
    def centers(self) -> np.ndarray:
        """Directions of the first codebook's words: those of the lists of the coarse partition."""
        first = self.words[0].astype(np.float64)
        return first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-300)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def fit(sample: np.ndarray, books: int = BOOKS, codes: int = CODES, rounds: int = FIT_ROUNDS, seed: int = 7) -> Books:
    """Residual k-means for the first fit, then each codebook is refitted on what the others leave."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    codes = max(1, min(codes, len(x)))
    words, rest = np.zeros((books, codes, x.shape[1]), np.float32), x.copy()
    for m in range(books):
        words[m] = rest[rng.choice(len(x), codes, replace=len(x) < codes)]
        for _ in range(rounds):
            near = _nearest(rest, words[m])
            _recentre(words[m], rest, near, rng)
        rest -= words[m][_nearest(rest, words[m])]
    found = Books(words)
    for _ in range(2):
        at, _, _ = encode(found, x)
        for m in range(books):
            others = x - sum(words[j][at[:, j]] for j in range(books) if j != m)
            _recentre(words[m], others, at[:, m], rng)
    return found


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = (words * words).sum(1) / 2
    return np.concatenate([(x[k : k + 4096] @ words.T - half).argmax(1) for k in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def _recentre(words: np.ndarray, x: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> None:
    sums = np.zeros_like(words)
    np.add.at(sums, near, x)
    n = np.bincount(near, minlength=len(words))
    words[n > 0] = sums[n > 0] / n[n > 0, None]
    if len(x) > len(words) and (n == 0).any():
        words[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]


def encode(found: Books, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n x BOOKS), norms of the reconstructions and their angles to ``x``: beam search over the codebooks in order."""
    words = found.words
    out, norms, angles = [], [], []
    for k in range(0, len(x), 512):
        part = x[k : k + 512].astype(np.float32)
        n, rows = len(part), np.arange(len(part))[:, None]
        made, codes = np.zeros((n, 1, part.shape[1]), np.float32), np.zeros((n, 1, 0), np.uint8)
        for book in words:
            rest = part[:, None, :] - made
            cost = (rest * rest).sum(2)[:, :, None] + (book * book).sum(1) - 2 * (rest @ book.T)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            b, c = best // len(book), best % len(book)
            codes = np.concatenate([codes[rows, b], c[:, :, None].astype(np.uint8)], 2)
            made = made[rows, b] + book[c]
        last = ((part[:, None, :] - made) ** 2).sum(2).argmin(1)
        final, exact = made[np.arange(n), last].astype(np.float64), x[k : k + 512].astype(np.float64)
        norm = np.linalg.norm(final, axis=1)
        along = final / np.maximum(norm, 1e-300)[:, None]
        cosine = (exact * along).sum(1)
        out.append(codes[np.arange(n), last])
        norms.append(norm)
        angles.append(np.arctan2(np.linalg.norm(exact - cosine[:, None] * along, axis=1), cosine))
    if not out:
        return np.empty((0, len(words)), np.uint8), np.empty(0), np.empty(0)
    return np.concatenate(out), np.concatenate(norms), np.concatenate(angles)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) with v array<double>: rows with an id whose vector is finite throughout, not zero, and of the common length.

    The common length is the one that most rows have (the longer one in a tie).
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("v") == (size["size"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(rows: DataFrame, k: int = 5) -> tuple[DataFrame, Books | None]:
    """The index of ``rows`` (vec_id, v): (list, ids, v, codes, norm, angle, spread) for each distinct vector, and its codebooks.

    Equal vectors share an entry with the smallest of their ids, each once: at most k + 1 are needed, since a query
    wants k neighbours besides itself; the rest of a group never meets in a task. ``list`` is the nearest of the
    first codebook's words, ``spread`` the angle to it. The index is in order of list and codes, so that a
    search reads only the parts that hold its lists; a crowd of equal codes is dealt out by a hash.
    """
    keyed = rows.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256))
    once = keyed.groupBy("key", "vec_id").agg(F.first("v").alias("v"))
    ranked = once.withColumn("n", F.expr("row_number() over (partition by key order by vec_id)")).where(F.col("n") <= k + 1)
    entries = materialize(ranked.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))
    total = entries.count()
    if not total:
        return entries.drop("key"), None
    share = min(1.0, FIT_ROWS / total)
    sample = entries.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / 1e6 < share * 1.1).limit(FIT_ROWS).select("v").toArrow()
    if not sample.num_rows:
        sample = entries.limit(FIT_ROWS).select("v").toArrow()
    found = fit(_unit(_matrix(sample.column("v").combine_chunks())))
    sent = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value.centers
        for batch in batches:
            unit = _unit(_matrix(batch.column("v")))
            codes, norms, angles = encode(sent.value, unit)
            near = unit @ centers.T
            at = near.argmax(1) if len(near) else np.empty(0, np.int64)
            columns = [pa.array(at.astype(np.int32)), batch.column("ids"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(angles)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_angles(near[np.arange(len(at)), at]))], ["list", "ids", "v", "codes", "norm", "angle", "spread"])

    indexed = entries.select("ids", "v").mapInArrow(run, "list int, ids array<long>, v array<double>, codes binary, norm double, angle double, spread double")
    order = ["list", "codes", F.xxhash64(F.col("ids")[0])]
    indexed = materialize(indexed)  # ranges are sampled first, which would encode all vectors twice
    return materialize(indexed.repartitionByRange(*order).sortWithinPartitions(*order)), found


def _within(approx: np.ndarray, angles: np.ndarray, slack: np.ndarray, least: np.ndarray) -> np.ndarray:
    """rows x queries: where the cosine may reach ``least``, given that of the row's reconstruction.

    The row lies within ``angles`` of its reconstruction, so by the triangle inequality of the sphere the query
    is at most arccos(least) + angles from the latter. ``slack`` covers the rounding of ``approx``.
    """
    c, s, t = np.cos(angles), np.sin(angles), np.clip(least, 0, 1)
    reach = np.outer(c, t) - np.outer(s, np.sqrt(1 - t * t)) - slack[:, None]
    return (approx >= reach) | (least <= 0) | (c <= 0)[:, None]


def _best(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, tie, score) the k best of each query, in order; an id counts once."""
    q, i, tie, _ = found
    order = np.lexsort((-tie, i, q))
    first = np.r_[True, (q[order][1:] != q[order][:-1]) | (i[order][1:] != i[order][:-1])][: len(order)]
    order = order[first]
    order = order[np.lexsort((i[order], -tie[order], q[order]))]
    at = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    return tuple(x[order[at < k]] for x in found)


def _runs(lists: np.ndarray, size: int) -> Iterator[slice]:
    """Runs of equal lists, cut into pieces of ``size`` rows at most."""
    edges = np.r_[0, np.flatnonzero(np.diff(lists)) + 1, len(lists)]
    for start, end in zip(edges[:-1], edges[1:]):
        for k in range(start, end, size):
            yield slice(k, min(k + size, end))


def _search_block(index: DataFrame, found: Books, ids: np.ndarray, queries: np.ndarray, asked: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, tie, score): for each query of a block the k best of each task's rows, of the lists it asks.

    ``asked`` tells queries x lists, ``least`` what a score must reach. Every row of these lists whose
    reconstruction does not rule it out is scored exactly, however many there are.
    """
    sent = index.sparkSession.sparkContext.broadcast((found, ids, queries, asked, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, query_ids, exact, asked, least = sent.value
        exact, least = _unit(exact), least.copy()  # of each query the score of its k-th best so far
        unit = exact.astype(np.float32)
        # what the 32-bit sums that make up an inner product may be off by
        off = np.finfo(np.float32).eps * (books.words.shape[2] + 2 * len(books.words)) * np.linalg.norm(books.words, axis=2).max(1).sum()
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        some, tables = None, None
        for batch in batches:
            vectors, members, lists = _unit(_matrix(batch.column("v"))), batch.column("ids"), batch.column("list").to_numpy()
            ends = np.r_[0, np.cumsum(members.value_lengths().to_numpy())]
            members = members.flatten().to_numpy()
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(vectors), -1)
            norms, angles = np.maximum(batch.column("norm").to_numpy(), 1e-12), batch.column("angle").to_numpy()
            for block in _runs(lists, ROW_BLOCK):
                now = np.flatnonzero(asked[:, lists[block.start]])
                if not len(now):
                    continue
                if some is None or not np.array_equal(now, some):
                    some = now  # lookup tables: inner products of the queries that ask this list with every code word
                    tables = np.einsum("qd,mcd->mcq", unit[some], books.words)
                part, target = vectors[block], exact[some]
                approx = reduce(np.add, (tables[m][codes[block, m]] for m in range(codes.shape[1]))) / norms[block, None].astype(np.float32)
                width = min(SHORTLIST, len(part))
                if width > k:  # k + 1 entries hold at least k ids besides the query's own
                    short = np.argpartition(-approx, width - 1, axis=0)[:width].T
                    scores = np.stack([part[r] @ target[q] for q, r in enumerate(short)])
                    least[some] = np.maximum(least[some], np.partition(scores, width - k - 1, axis=1)[:, width - k - 1])
                within = _within(approx, angles[block], off / norms[block] + 1e-6, least[some] - 2 / TIE)
                if within.mean() > DENSE:
                    scores = part @ target.T
                    if len(part) > k:
                        least[some] = np.maximum(least[some], np.partition(scores, len(part) - k - 1, axis=0)[len(part) - k - 1])
                    r, q = np.nonzero(scores >= least[some] - 2 / TIE)
                    s = scores[r, q]
                else:
                    r, q = np.nonzero(within)
                    s = np.concatenate([np.einsum("nd,nd->n", part[r[j : j + 65536]], target[q[j : j + 65536]]) for j in range(0, len(r), 65536)] or [np.empty(0)])
                    r, q, s = (x[s >= least[some][q] - 2 / TIE] for x in (r, q, s))
                r, q = r + block.start, some[q]
                sizes = ends[r + 1] - ends[r]
                at = np.repeat(ends[r] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                q, i, s = np.repeat(q, sizes), members[at], np.repeat(s, sizes)
                other = i != query_ids[q]
                new = (q[other], i[other], np.rint(s[other] * TIE).astype(np.int64), s[other])
                best = _best(tuple(np.concatenate(x) for x in zip(best, new)), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(exact)) == k)
                least[full] = np.maximum(least[full], best[3][np.searchsorted(best[0], full, side="right") - 1])
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]], pa.int64()), *(pa.array(x) for x in best[1:])], ["query_id", "vec_id", "tie", "score"])

    wanted = np.flatnonzero(asked.any(0)).tolist()
    rows = index.where(F.col("list").isin(wanted)) if wanted else index.limit(0)
    return rows.mapInArrow(run, "query_id long, vec_id long, tie long, score double")


def _blocks_of_lists(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """By list the first of its blocks and their number, so that blocks have about ``size`` queries of few lists."""
    out, block, held = {}, 0, 0
    for at, n in sorted(counts.items()):
        if held and held + n > size:
            block, held = block + 1, 0
        many = 1 if n <= size else 2 * -(-n // size)
        out[at] = (block, many)
        held += n
        if many > 1:
            block, held = block + many, 0
    return out


def _with_lists(asked: DataFrame, found: Books) -> DataFrame:
    """``asked`` (vec_id, v) with the list that is nearest to each."""
    sent = asked.sparkSession.sparkContext.broadcast(found.centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_unit(_matrix(batch.column("v"))) @ sent.value.T).argmax(1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "v", "list"])

    return asked.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, list int")


def _best_of_tasks(parts: list[DataFrame]) -> DataFrame:
    """(query_id, vec_id, tie, score) of what tasks found, an id once for each query."""
    return reduce(DataFrame.union, parts).groupBy("query_id", "vec_id").agg(F.max(F.struct("tie", "score")).alias("x")).select("query_id", "vec_id", "x.tie", "x.score")


def search(vectors: DataFrame, every: int = 50, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose vec_id is divisible by ``every``.

    All rows but the query's own id are candidates. Queries go out in blocks of about QUERY_BLOCK, those of a list
    together. A block first searches its queries' own lists; the k-th best found there and the spread of each
    other list tell by the triangle inequality which of these may hold a better one, and only those are read.
    Lists and codes only rule rows out: all that may be among the k best are scored exactly, so none is missed.
    Scores are cosines of the original vectors in double precision; ties (to TIE) go to the smaller vec_id.
    Fewer candidates: all of them. Ids are taken to be unique; a repeated row counts as one neighbour. Vectors
    that ``usable`` leaves out take no part. An empty table gives no rows.
    """
    rows = usable(vectors, vector)
    index, found = build(rows, k)
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.first("v").alias("v"))
    if not found:
        return empty
    asked = materialize(_with_lists(asked, found))
    # as many rows as the first codebook has words
    counts = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return empty
    spread = np.full(len(found.centers), -1.0)
    for r in index.groupBy("list").agg(F.max("spread").alias("s")).collect():
        spread[r["list"]] = r["s"]
    places = _blocks_of_lists(counts, QUERY_BLOCK)
    place = F.element_at(F.create_map(*[x for at, (b, n) in places.items() for x in (F.lit(at), F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")))]), F.col("list"))
    asked = materialize(asked.withColumn("block", place["b"] + F.pmod(F.xxhash64("vec_id"), place["n"])))
    blocks = sorted({b + j for b, n in places.values() for j in range(n)})

    own = []
    for b in blocks:
        table = asked.where(F.col("block") == b).toArrow()
        if table.num_rows:
            ids, v, lists = _columns(table)
            mine = np.zeros((len(ids), len(spread)), bool)
            mine[np.arange(len(ids)), lists] = True
            own.append(_search_block(index, found, ids, v, mine, np.full(len(ids), -np.inf), k))
    first = materialize(_best_of_tasks(own))
    kth = first.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("least"))
    asked = materialize(asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "list", "block", F.coalesce("least", F.lit(-2.0)).alias("least")))

    others = []
    for b in blocks:
        table = asked.where(F.col("block") == b).toArrow()
        if table.num_rows:
            ids, v, lists = _columns(table)
            least = table.column("least").to_numpy()
            # no row of a list is nearer than the angle to its center less its spread
            reach = np.cos(np.maximum(_angles(_unit(v) @ found.centers.T) - spread - 1e-6, 0))
            open_ = (reach >= least[:, None] - 1e-9) & (spread >= 0)
            open_[np.arange(len(ids)), lists] = False
            if open_.any():
                others.append(_search_block(index, found, ids, v, open_, np.where(least < -1, -np.inf, least), k))
    best = _best_of_tasks([first, *others])
    order = "row_number() over (partition by query_id order by tie desc, vec_id)"
    return best.withColumn("rank", F.expr(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks()), table.column("list").to_numpy()
