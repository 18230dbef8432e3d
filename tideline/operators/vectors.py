"""Vector operators: similarity, group statistics, projections, scaling and reducers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Queries of a nearest-neighbour search that are broadcast at a time.
QUERY_BLOCK = 2048
#: Rows that a block of queries is multiplied with at a time.
ROW_SLICE = 1024
#: Rows of a block where all pairs of a group are formed, and of the slice of one whose pairs are made at a time.
PAIR_BLOCK, PAIR_SLICE = 1024, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def pairwise(df: DataFrame, group: str, id_: str, vector: str) -> DataFrame:
    """(group, a, b, cosine, distance) for ordered pairs of different ids within a group."""
    return pair_measures(df, group, id_, {"cosine": ("cosine", vector), "distance": ("euclidean", vector)})


def pair_measures(df: DataFrame, group: str, id_: str, measures: dict[str, tuple[str, str]], ordered: bool = True) -> DataFrame:
    """(group, a, b, measures) for pairs of different ids within a group, both orders or a < b only.

    ``measures``: name -> (cosine | euclidean, vector column). A group is dealt into blocks of about PAIR_BLOCK rows by a
    hash, and each two blocks meet in a group of their own: the work is quadratic, but a task holds two blocks and
    the pairs of a slice of one, and no group lands in one task. Null, nulls within and unlike lengths give null, and
    so does the cosine of a zero vector.
    """
    names, kinds = list(dict.fromkeys(v for _, v in measures.values())), df.schema
    rows = df.where(F.col(group).isNotNull() & F.col(id_).isNotNull()).select(F.col(group).alias("g"), F.col(id_).alias("id"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(names)])
    counts = rows.groupBy("g").agg(F.ceil(F.count("*") / F.lit(PAIR_BLOCK)).alias("blocks"))
    rows = rows.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    of = {name: (kind, f"v{names.index(v)}") for name, (kind, v) in measures.items()}

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        one = t["lo"][0].as_py() == t["hi"][0].as_py()
        left = t if one else t.filter(pc.equal(t["block"], t["lo"]))
        right = t if one else t.filter(pc.equal(t["block"], t["hi"]))
        for at in range(0, left.num_rows, PAIR_SLICE):
            part = left.slice(at, PAIR_SLICE).combine_chunks()
            i, j = (x.ravel() for x in np.meshgrid(np.arange(part.num_rows), np.arange(right.num_rows), indexing="ij"))
            a, b = part["id"].take(pa.array(i)).combine_chunks(), right["id"].take(pa.array(j)).combine_chunks()
            found = {name: _measured(kind, part[v], right[v]) for name, (kind, v) in of.items()}
            keep = pc.less(a, b) if one and not ordered else pc.not_equal(a, b)
            swapped = None if one or ordered else pc.less(b, a)
            ends = (a, b) if swapped is None else (pc.if_else(swapped, b, a), pc.if_else(swapped, a, b))
            g = pa.repeat(t["g"][0], len(a))
            made = pa.RecordBatch.from_arrays([g, *ends, *found.values()], [group, "a", "b", *found]).filter(keep)
            yield made
            if ordered and not one:
                yield pa.RecordBatch.from_arrays([made.column(0), made.column(2), made.column(1), *made.columns[3:]], made.schema.names)

    key = kinds[id_].dataType.simpleString()
    schema = ", ".join([f"{group} {kinds[group].dataType.simpleString()}, a {key}, b {key}", *[f"{m} double" for m in measures]])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return rows.groupBy("g", "lo", "hi").applyInArrow(blocks, schema)


def _stacked(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (rows, matrix) of the vectors without nulls."""
    column = column.combine_chunks()
    whole = np.ones(len(column), bool)
    values = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if column.null_count:
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
    if values.null_count:
        whole[np.repeat(np.arange(len(column)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]] = False
    starts, x = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), values.to_numpy(zero_copy_only=False).astype(float)
    out = {}
    for n in np.unique(sizes[whole]):
        rows = np.flatnonzero(whole & (sizes == n))
        out[int(n)] = (rows, x[starts[rows][:, None] + np.arange(n)])
    return out


def _measured(kind: str, a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.Array:
    """The measure of each row of ``a`` with each of ``b``, row by row; components are added in order."""
    out, none = np.zeros((len(a), len(b))), np.ones((len(a), len(b)), bool)
    left, right = _stacked(a), _stacked(b)
    for n in left.keys() & right.keys():
        (i, x), (j, y) = left[n], right[n]
        y = np.ascontiguousarray(y.T)
        total, step = np.zeros((len(i), len(j))), np.empty((len(i), len(j)))
        for d in range(n):
            if kind == "euclidean":
                np.subtract(x[:, d : d + 1], y[d], out=step)
                np.multiply(step, step, out=step)
            else:
                np.multiply(x[:, d : d + 1], y[d], out=step)
            total += step
        bad = np.zeros(total.shape, bool)
        if kind == "euclidean":
            np.sqrt(total, out=total)
        else:
            norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(0))
            bad = norms == 0
            np.divide(total, norms, out=total, where=~bad)
        at = np.ix_(i, j)
        out[at], none[at] = total, bad
    return pa.array(out.ravel(), mask=none.ravel() if none.any() else None)


def nearest(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(query, rank, id, cosine): the exact k most similar vectors of each query, itself left out.

    Queries go out in blocks of at most about QUERY_BLOCK vectors, each against all rows by one product of matrices for
    each ROW_SLICE rows; a task keeps k rows of each query and holds one such product. Scores that agree to 12 decimals are ties, which go to the smaller
    id. Vectors that are null or zero take no part.
    """
    kind = vectors.schema[id_].dataType.simpleString()
    doubles = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_).alias("id"), doubles.alias("v")).where(F.exists("v", lambda x: x != 0))
    asked = queries.select(F.col(id_).alias("query"), doubles.alias("vq")).where(F.exists("vq", lambda x: x != 0))
    blocks = -(-asked.count() // QUERY_BLOCK)
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks or 1))))
    schema = f"query {kind}, id {kind}, cosine double"
    parts = [_nearest_to_block(rows, asked.where(F.col("block") == b).toArrow(), k, schema) for b in range(blocks)]
    found = reduce(DataFrame.union, parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest_to_block(rows: DataFrame, asked: pa.Table, k: int, schema: str) -> DataFrame:
    if not asked.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast((asked.column("query").to_pylist(), _matrix(asked.column("vq"))))

    def run(batches):
        names, block = sent.value
        who = np.array(names)
        best: list[list[tuple]] = [[] for _ in names]  # (-rounded cosine, id, cosine), in order
        least = np.full(len(names), -np.inf)  # below this nothing can enter; it is left open until k are known
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_SLICE):
                part = batch.slice(at, ROW_SLICE)
                ids, scores = part.column("id").to_pylist(), _matrix(part.column("v")) @ block.T
                width, cut = min(k + 1, len(ids)), least - 1e-11
                if np.isinf(cut).any():
                    # all rows that tie with the last of the k + 1 highest, since ties are decided by id
                    cut = np.maximum(cut, np.partition(scores, len(ids) - width, axis=0)[len(ids) - width] - 1e-11)
                r, q = np.nonzero(scores >= cut)
                other = np.array(ids)[r] != who[q]
                r, q = r[other], q[other]
                down, place = -np.round(scores[r, q], 12), np.empty(len(ids), int)
                place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
                order = np.lexsort((place[r], down, q))
                q = q[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k  # the k best of a query are enough
                met: dict[int, list[tuple]] = {}
                for x, row in zip(q[first].tolist(), order[first].tolist()):
                    score = float(scores[r[row], x])
                    met.setdefault(x, []).append((-round(score, 12), ids[r[row]], score))
                for x, some in met.items():
                    best[x] = sorted(best[x] + some)[:k]
                    if len(best[x]) == k:
                        least[x] = -best[x][-1][0]
        out = [(name, i, c) for name, some in zip(names, best) for _, i, c in some]
        columns = list(zip(*out)) if out else [(), (), ()]
        kind = asked.schema.field("query").type
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())], ["query", "id", "cosine"])

    return rows.mapInArrow(run, schema)


def dimensions(df: DataFrame, keep: list[str], vector: str) -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def group_statistics(df: DataFrame, group: str, vector: str) -> DataFrame:
    """For each group and dimension the sample variance, mean, sample deviation, dispersion and variation."""
    rows = dimensions(df, [group], vector).groupBy(group, "dim")
    rows = rows.agg(F.var_samp("x").alias("variance"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))
    return rows.withColumns({"dispersion": F.try_divide("variance", "mean"), "variation": F.try_divide("deviation", "mean")})


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): elementwise means."""
    means = dimensions(df, [group], vector).groupBy(group, "dim").agg(F.avg("x").alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def covariance_trace(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, trace): the sum over rows of each row's population variance."""
    n, v = F.size(vector), F.transform(vector, lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    rows = df.select(group, v.alias("v"), mean.alias("m"), n.alias("n"))
    own = F.aggregate(F.transform("v", lambda x: F.pow(x - F.col("m"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / F.col("n")
    return rows.groupBy(group).agg(F.sum(own).alias("trace"))


def zscores(df: DataFrame, id_: str, vector: str, population: bool = True) -> DataFrame:
    """(id, dim, z): each dimension centred and scaled; 0 where it doesn't vary. Statistics are one row a dimension."""
    rows = dimensions(df, [id_], vector)
    spread = F.stddev_pop("x") if population else F.stddev_samp("x")
    stats = rows.groupBy("dim").agg(F.avg("x").alias("m"), spread.alias("s"))
    return rows.join(stats, "dim").select(id_, "dim", F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))


def project(df: DataFrame, vector: str, matrix: np.ndarray, out: str = "projected") -> DataFrame:
    """``df`` with ``out``: the vector times each row of ``matrix``, a literal."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in matrix])
    return df.withColumn(out, F.transform(rows, lambda r: dot(F.col(vector), r)))


def murmur3_32(data: bytes, seed: int) -> int:
    """The 32-bit MurmurHash3."""
    mask, h, n = 0xFFFFFFFF, seed, len(data) // 4 * 4
    mix = lambda k: ((((k * 0xCC9E2D51) & mask) << 15 | ((k * 0xCC9E2D51) & mask) >> 17) & mask) * 0x1B873593 & mask
    for i in range(0, n, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if data[n:]:
        h ^= mix(int.from_bytes(data[n:], "little"))
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & mask
    return h ^ h >> 16


def stream_hash_matrix(n_out: int, names: list[str], density: float = 1 / 3) -> np.ndarray:
    """Sparse projection fixed by hashes of feature names: -c, c or 0, whatever features come later."""
    c = np.sqrt(1 / density) / np.sqrt(n_out)

    def entry(name: str, k: int) -> float:
        h = murmur3_32(name.encode(), k) / 0xFFFFFFFF
        return -c if h <= density / 2 else c if h <= density else 0.0

    return np.array([[entry(f, k) for f in names] for k in range(n_out)])


def gaussian_matrix(n_out: int, n_in: int, seed: int = 0) -> np.ndarray:
    return np.round(np.random.default_rng(seed).standard_normal((n_out, n_in)) / np.sqrt(n_out), 6)


def equal_width_buckets(df: DataFrame, value: str, spread: float) -> DataFrame:
    """``df`` with ``bucket``: int((max - min) / spread) right-closed bins of equal width (at least one)."""
    from .relational import equal_width_bins

    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return equal_width_bins(df, value, max(1, int(((ends["hi"] or 0) - (ends["lo"] or 0)) / spread))).withColumnRenamed("bin", "bucket")


# reducers fitted on a bounded first part of the rows


@dataclass(frozen=True)
class Reducer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # out x in
    bias: np.ndarray
    relu: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.divide(x - self.mean, self.scale, out=np.zeros_like(x, float), where=self.scale > 0) @ self.weights.T + self.bias
        return np.maximum(y, 0) if self.relu else y


def first_rows(df: DataFrame, seq: str, vector: str, rows: int = 256) -> np.ndarray:
    """The vectors of the first ``rows`` rows by ``seq``."""
    found = df.orderBy(seq).limit(rows).select(vector).collect()
    return np.array([r[0] for r in found], float)


def _scaled(x: np.ndarray, ddof: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0, ddof=ddof)
    return np.divide(x - mean, scale, out=np.zeros_like(x), where=scale > 0), mean, scale


def fit_pca(x: np.ndarray, n_out: int = 12) -> Reducer:
    """Principal axes of z-scores (population deviation), each with its largest weight positive."""
    z, mean, scale = _scaled(x, 0)
    _, _, axes = np.linalg.svd(z - z.mean(0), full_matrices=False)
    axes = axes[:n_out]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return Reducer(mean, scale, axes, -axes @ z.mean(0))


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.n += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)


def fit_autoencoder(x: np.ndarray, n_out: int = 12, epochs: int = 300, rate: float = 0.01, seed: int = 0) -> Reducer:
    """One ReLU layer each way, squared error, Adam over the whole sample; the encoder is what is kept."""
    z, mean, scale = _scaled(x, 1)
    rng = np.random.default_rng(seed)
    n, d = z.shape
    w1, w2 = rng.uniform(-1, 1, (n_out, d)) / np.sqrt(d), rng.uniform(-1, 1, (d, n_out)) / np.sqrt(n_out)
    b1, b2 = np.zeros(n_out), np.zeros(d)
    adam = _Adam([w1, b1, w2, b2], rate)
    for _ in range(epochs):
        h = np.maximum(z @ w1.T + b1, 0)
        g = 2 * (h @ w2.T + b2 - z) / z.size
        back = (g @ w2) * (h > 0)
        adam.step([back.T @ z, back.sum(0), g.T @ h, g.sum(0)])
    return Reducer(mean, scale, w1, b1, True)


def fit_information_bottleneck(x: np.ndarray, y: np.ndarray, n_out: int = 12, beta: float = 0.5, epochs: int = 200, rate: float = 0.01, seed: int = 0) -> Reducer:
    """A linear code with unit noise that keeps what tells ``y`` (0/1) and little of ``x``.

    Minimises the logistic loss in bits plus beta times a kernel-density bound of the code's information.
    """
    z, mean, scale = _scaled(x, 1)
    rng = np.random.default_rng(seed)
    n, d = z.shape
    w, b = rng.uniform(-1, 1, (n_out, d)) / np.sqrt(d), np.zeros(n_out)
    u, c = rng.uniform(-1, 1, n_out) / np.sqrt(n_out), np.zeros(1)
    adam = _Adam([w, b, u, c], rate)
    for _ in range(epochs):
        t = z @ w.T + b
        noisy = t + rng.standard_normal(t.shape)
        p = 1 / (1 + np.exp(-(noisy @ u + c)))
        g = (p - y) / n / np.log(2)
        # I(X;T) <= -mean log mean exp(-|ti - tj|^2 / 2)
        k = np.exp(-((t[:, None] - t[None]) ** 2).sum(2) / 2)
        k /= k.sum(1, keepdims=True)
        both = k + k.T
        info = (both.sum(1)[:, None] * t - both @ t) / n / np.log(2)
        gt = np.outer(g, u) + beta * info
        adam.step([gt.T @ z, gt.sum(0), noisy.T @ g, np.array([g.sum()])])
    return Reducer(mean, scale, w, b)


def reduced(df: DataFrame, vector: str, model: Reducer, out: str = "reduced") -> DataFrame:
    """``df`` with ``out``, the model over all rows in batches; the model goes out with the task."""
    kind = "array<double>"

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(model(np.array(v.tolist(), float)))) if len(v) else v

    return df.withColumn(out, run(vector))


def reduced_to_line(df: DataFrame, seq: str, vector: str, out: str = "position", model: Reducer | None = None) -> DataFrame:
    """``df`` with a one-dimensional position, smallest 0: by default the first principal axis."""
    model = model or fit_pca(first_rows(df, seq, vector), 1)
    rows = reduced(df, vector, model, "__line").withColumn(out, F.col("__line")[0]).drop("__line")
    low = rows.agg(F.min(out).alias("lo")).first()["lo"]
    return rows.withColumn(out, F.col(out) - F.lit(low or 0.0))


def projection_quality(pairs: DataFrame) -> DataFrame:
    """Spearman correlation of pair distances before and after (columns ``before``, ``after``)."""
    from .evaluate import spearman

    return spearman(pairs, "before", "after")


def similarity_within_and_between(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, within, between): mean cosine to the own group and to the others, from sums of unit vectors.

    No pairs are formed: the sum of cosines of a group with another is the product of their sums.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    unit = F.transform("__v", lambda x: x / F.col("__n"))
    rows = df.withColumn("__v", v).withColumn("__n", F.sqrt(dot(F.col("__v"), F.col("__v")))).where(F.col("__n") > 0).select(group, unit.alias("u"))
    sums = dimensions(rows, [group], "u").groupBy(group, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy("dim").agg(F.sum("s").alias("t"), F.sum("n").alias("all"))
    joined = sums.join(total, "dim").groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("own"), F.sum(F.col("s") * F.col("t")).alias("any"), F.max("n").alias("n"), F.max("all").alias("all"))
    n, others = F.col("n"), F.col("all") - F.col("n")
    return joined.select(group, F.try_divide(F.col("own") - n, n * (n - 1)).alias("within"), F.try_divide(F.col("any") - F.col("own"), n * others).alias("between"))
