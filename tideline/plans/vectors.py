"""Queries on embeddings, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vectors as V

QUERIES, SQL = {}, {}
_GROUPS = 10


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.col("label").cast("long")))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_E = "e as (select vec_id, cast(label as bigint) as label, cast(embedding as double[]) as v from embeddings)"


@query(f"""with {_E} select a.label, a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as cosine, round(list_distance(a.v, b.v), 6) as distance
from e a join e b on a.label = b.label and a.vec_id <> b.vec_id""")
def pairwise_similarity(e: DataFrame) -> DataFrame:
    rows = V.pairwise(e, "label", "vec_id", "embedding")
    return rows.select("label", "a", "b", F.round("cosine", 6).alias("cosine"), F.round("distance", 6).alias("distance"))


@query(f"""with {_E}, r as (select q.vec_id as query, e.vec_id as id, list_cosine_similarity(q.v, e.v) as c from e q join e on e.vec_id <> q.vec_id where q.vec_id % 20 = 0),
k as (select *, row_number() over (partition by query order by c desc, id) as rank from r) select query, rank, id, round(c, 6) as cosine from k where rank <= 4""")
def knn_top4(e: DataFrame) -> DataFrame:
    return V.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 4).select("query", F.col("rank").cast("long").alias("rank"), "id", F.round("cosine", 6).alias("cosine"))


_D = f"{_E}, d as (select vec_id, label, unnest(range(0, len(v))) as dim, unnest(v) as x from e)"


@query(f"""with {_D} select label, dim, round(var_samp(x), 6) as variance, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as deviation from d group by 1, 2""")
def group_stats(e: DataFrame) -> DataFrame:
    rows = V.group_statistics(e, "label", "embedding")
    return rows.select("label", F.col("dim").cast("long").alias("dim"), *[F.round(c, 6).alias(c) for c in ("variance", "mean", "deviation")])


@query(f"with {_D}, m as (select label, dim, avg(x) as m from d group by 1, 2) select label, round(list_sum(list(abs(m) order by dim)), 6) as mass, round(max(m) filter (dim = 0), 6) as first, count(*) as dims from m group by 1")
def centroids(e: DataFrame) -> DataFrame:
    rows = V.centroids(e, "label", "embedding")
    mass = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + F.abs(x))
    return rows.select("label", F.round(mass, 6).alias("mass"), F.round(F.col("centroid")[0], 6).alias("first"), F.size("centroid").cast("long").alias("dims"))


@query(f"with {_D}, r as (select vec_id, label, var_pop(x) as v from d group by 1, 2) select label, round(sum(v), 6) as trace from r group by 1")
def covariance_trace(e: DataFrame) -> DataFrame:
    return V.covariance_trace(e, "label", "embedding").select("label", F.round("trace", 6).alias("trace"))


@query(f"""with {_E}, p as (select a.label, b.label as other, list_cosine_similarity(a.v, b.v) as c from e a join e b on a.vec_id <> b.vec_id)
select label, round(avg(c) filter (other = label), 6) as within, round(avg(c) filter (other <> label), 6) as between from p group by 1""")
def group_similarity(e: DataFrame) -> DataFrame:
    rows = V.similarity_within_and_between(e, "label", "embedding")
    return rows.select("label", F.round("within", 6).alias("within"), F.round("between", 6).alias("between"))


_HASHED = V.stream_hash_matrix(8, [f"f{i}" for i in range(64)])
_GAUSS = V.gaussian_matrix(8, 64, 3)


def _projected(matrix) -> str:
    rows = ", ".join("[" + ", ".join(f"{float(x)!r}::double" for x in r) + "]" for r in matrix)
    return f"with {_E}, m as (select unnest([{rows}]) as r, unnest(range(0, {len(matrix)})) as dim) select vec_id, dim, round(list_inner_product(v, r), 5) as x from e, m"


def _long(e: DataFrame, matrix) -> DataFrame:
    rows = V.project(e, "embedding", matrix).select("vec_id", F.posexplode("projected").alias("dim", "x"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


@query(_projected(_HASHED))
def streamhash_projection(e: DataFrame) -> DataFrame:
    return _long(e, _HASHED)


@query(_projected(_GAUSS))
def gaussian_projection(e: DataFrame) -> DataFrame:
    return _long(e, _GAUSS)


_GSQL = ", ".join("[" + ", ".join(f"{float(x)!r}::double" for x in r) + "]" for r in _GAUSS)


@query(f"""with {_E}, g as (select vec_id, label, v, list_transform([{_GSQL}], lambda r: list_inner_product(v, r)) as p from e),
d as (select round(list_distance(a.v, b.v), 9) as x, round(list_distance(a.p, b.p), 9) as y from g a join g b on a.label = b.label and a.vec_id < b.vec_id),
r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from d)
select round(corr(rx, ry), 6) as spearman from r""")
def projection_quality(e: DataFrame) -> DataFrame:
    rows = V.project(e, "embedding", _GAUSS)
    pairs = V.pair_measures(rows, "label", "vec_id", {"before": ("euclidean", "embedding"), "after": ("euclidean", "projected")}, ordered=False)
    pairs = pairs.select(F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))
    return V.projection_quality(pairs).select(F.round("spearman", 6).alias("spearman"))


@query(f"with {_D}, s as (select dim, avg(x) as m, stddev_pop(x) as s from d group by 1) select vec_id, dim, round(case when s > 0 then (x - m) / s else 0 end, 5) as z from d join s using (dim)")
def zscore(e: DataFrame) -> DataFrame:
    return V.zscores(e, "vec_id", "embedding").select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("z", 5).alias("z"))


@query("""with e as (select vec_id, cast(embedding[1] as double) as x from embeddings), m as (select min(x) as lo, max(x) as hi, greatest(1, cast(trunc((max(x) - min(x)) / 0.25) as bigint)) as n from e)
select cast(greatest(ceil(round((x - lo) / ((hi - lo) / n), 9)) - 1, 0) as bigint) as bucket, count(*) as n from e, m group by 1""")
def lsh_bucket_1d(e: DataFrame) -> DataFrame:
    rows = e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return V.equal_width_buckets(rows, "x", 0.25).groupBy("bucket").agg(F.count("*").alias("n"))


def _spread(e: DataFrame, model: V.Reducer) -> DataFrame:
    rows = V.reduced(e, "embedding", model).select(F.posexplode("reduced").alias("dim", "x"))
    return rows.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.var_pop("x"), 6).alias("variance"))


@query(None)
def pca_variance(e: DataFrame) -> DataFrame:
    return _spread(e, V.fit_pca(V.first_rows(e, "vec_id", "embedding")))


@query(None)
def autoencoder(e: DataFrame) -> DataFrame:
    return _spread(e, V.fit_autoencoder(V.first_rows(e, "vec_id", "embedding")))


@query(None)
def information_bottleneck(e: DataFrame) -> DataFrame:
    x = V.first_rows(e, "vec_id", "embedding")
    y = V.first_rows(e.withColumn("y", F.array((F.col("label") < 5).cast("double"))), "vec_id", "y")[:, 0]
    return _spread(e, V.fit_information_bottleneck(x, y))


@query(None)
def reduce_to_line(e: DataFrame) -> DataFrame:
    return V.reduced_to_line(e, "vec_id", "embedding").select("vec_id", F.round("position", 6).alias("position"))
