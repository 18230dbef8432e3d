"""Queries of the scoring kernel over events, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timebuckets import ceil_bucket, epoch_seconds
from ..operators import buckets as B
from ..operators import scorer as S
from ..operators.prefix import clocked
from ..params import ScorerParams

STEP = 6 * 3600
PARAMS = ScorerParams(
    rows=2, buckets=48, alpha=0.8, beta=0.5, min_count=1.0, hashes=((5, 7), (11, 23)),
    planes=tuple(tuple((round(0.37 * (b + 1) - 0.9 + r * 0.21, 3), round(0.8 - 0.29 * b - r * 0.17, 3)) for b in range(6)) for r in range(2)),
)
NUMERIC, CODES = ["value", "m7"], ["user_code", "type_code"]


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a record stream: two numbers (one with zeros), two codes from 1 up, a six-hour clock."""
    types = F.create_map(*[F.lit(x) for i, t in enumerate(("click", "error", "purchase", "signup", "view"), 1) for x in (t, i)])
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("seq"),
        epoch_seconds(ceil_bucket(F.col("ts"), STEP)).alias("t"),
        F.col("value"),
        (F.col("event_id") % 7).cast("double").alias("m7"),
        (F.col("user_id") + 1).alias("user_code"),
        F.coalesce(F.element_at(types, F.col("event_type")), F.lit(0)).cast("long").alias("type_code"),
        (F.col("event_id") % 5 == 0).cast("int").alias("ignore"),
    )


def _feature(spark, sf_dir, numeric, codes, params, feature, record=False) -> DataFrame:
    found, _ = S.feature_scores(clocked(stream(spark, sf_dir)), numeric, codes, params, record)
    return found.where(F.col("feature") == feature).select("seq", "k", F.round("score", 6).alias("score"))


def score_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, [], ["user_code"], PARAMS, "user_code")


def score_numeric_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, ["m7"], [], PARAMS, "m7")


def score_numeric_apriori(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, ["value"], [], ScorerParams(**{**PARAMS.__dict__, "normaliser": "apriori"}), "value")


def score_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature(spark, sf_dir, NUMERIC, CODES, PARAMS, "record", record=True)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(stream(spark, sf_dir), NUMERIC, CODES, PARAMS)


def score_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("seq", "k", *[F.round(c, 6).alias(c) for c in ["score", *[f"{x}_score" for x in ["record", *NUMERIC, *CODES]]]])


def score_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("seq", *[F.round(f"{x}_share", 6).alias(f"{x}_share") for x in ["record", *NUMERIC, *CODES]])


def score_text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as the lines of a text file, six decimals."""
    return _scored(spark, sf_dir).select("seq", F.format_string("%.5f", F.round("score", 5)).alias("line"))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clocked(stream(spark, sf_dir))
    found, _ = S.feature_scores(rows, [], ["user_code"], PARAMS, record=False)
    a, b = PARAMS.linear()[-1]
    placed = rows.withColumn("bucket", S.code_bucket(F.col("user_code"), a, b, PARAMS.buckets)).select("seq", F.col("user_code").alias("value"), "bucket")
    return found.join(placed, "seq").select("seq", "k", "feature", "bucket", "value", F.round("score", 6).alias("score"))


def bucket_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.journal(_journal(spark, sf_dir))
    return rows.select("k", "feature", "bucket", F.size("entries").cast("long").alias("n"), F.element_at("entries", 1)["value"].alias("first_value"),
                       F.round(F.aggregate("entries", F.lit(0.0), lambda a, x: a + x["score"]), 6).alias("score_sum"))


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.statistics(_journal(spark, sf_dir))


def buckets_by_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_collisions(_journal(spark, sf_dir)).limit(10)


def bucket_active_at_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.active_at(_journal(spark, sf_dir), 20)
    return rows.select("bucket", "n", F.round("score_sum", 6).alias("score_sum"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values"))


def bucket_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") + 1).alias("code"), F.concat(F.lit("user-"), F.col("user_id")).alias("label")).distinct()
    return B.decode(_journal(spark, sf_dir), lookup).groupBy("bucket", "label").agg(F.count("*").alias("n"))


def bucket_dump_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal written as lines of nested lists and read back."""
    lines = B.dump(_journal(spark, sf_dir), PARAMS.buckets)
    return B.read_dump(lines).select("k", "bucket", F.col("value").cast("long").alias("value"), F.round("score", 6).alias("score"))


def global_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).agg(*[g(c).alias(f"{n}_{c}") for c in NUMERIC for n, g in (("min", F.min), ("max", F.max))])


def dense_timestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocked(stream(spark, sf_dir)).select("seq", "k")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.score(stream(spark, sf_dir).drop("ignore"), [], ["user_code"], PARAMS)
    return rows.select("seq", "k", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "seq").limit(10)


# SQL

_BASE = f"""
base as (select event_id as seq, cast(ceil(epoch_us(ts) / {STEP}000000.0) as bigint) * {STEP} as t, value, cast(event_id % 7 as double) as m7, user_id + 1 as user_code,
    case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 when 'view' then 5 else 0 end as type_code, case when event_id % 5 = 0 then 1 else 0 end as ign from events),
ck0 as (select *, max(t) over (order by seq rows unbounded preceding) as ct from base),
ck as (select *, dense_rank() over (order by ct) as k from ck0)"""


def _streaming(c: str) -> str:
    x = f"case when {c} <> 0 then log10(1 + {c}) end"
    return f"min({x}) over (order by seq rows unbounded preceding) as lo_{c}, max({x}) over (order by seq rows unbounded preceding) as hi_{c}"


def _v(c: str) -> str:
    return f"case when {c} = 0 then null when hi_{c} = lo_{c} then 0.0 else round((log10(1 + {c}) - lo_{c}) / (hi_{c} - lo_{c}), 12) end as v_{c}"


_NORMAL = f"nm0 as (select *, {', '.join(map(_streaming, NUMERIC))} from ck), nm as (select *, {', '.join(map(_v, NUMERIC))} from nm0)"
_APRIORI = "nm as (select *, round((log10(1 + value) - log10(1 + lo)) / (log10(1 + hi) - log10(1 + lo)), 12) as v_value from ck, (select min(value) as lo, max(value) as hi from base))"
_PLAIN = "nm as (select * from ck)"
_NB = PARAMS.buckets


def _numeric_cell(c: str) -> str:
    return f"select seq, k, '{c}' as feature, 0 as h, ((cast(floor(v_{c} * {_NB - 1}) as bigint) % {_NB}) + {_NB}) % {_NB} as b from nm where {c} <> 0"


def _code_cells(c: str) -> str:
    return " union all ".join(f"select seq, k, '{c}' as feature, {r} as h, ({c} * {a} + {b}) % {_NB} as b from nm" for r, (a, b) in enumerate(PARAMS.hashes))


def _record_cells() -> str:
    out = []
    for r, (a, b) in enumerate(PARAMS.hashes):
        bits = " + ".join(f"case when coalesce(v_value, 0) * {PARAMS.planes[r][j][0]}::double + coalesce(v_m7, 0) * {PARAMS.planes[r][j][1]}::double >= 0 then {1 << j} else 0 end" for j in range(PARAMS.bits))
        codes = " + ".join(f"({c} * {a + 2 * j} + {b}) % {_NB}" for j, c in enumerate(CODES))
        out.append(f"select seq, k, 'record' as feature, {r} as h, ({bits} + {codes}) % {_NB} as b from nm")
    return " union all ".join(out)


def _kernel(normal: str, *cells: str) -> str:
    """CTEs up to ``sc`` (seq, k, feature, s)."""
    return f"""with {_BASE}, {normal}, cells as ({' union all '.join(cells)}),
n as (select feature, h, b, k, count(*) as n from cells group by all),
pr as (select a.feature, a.h, a.b, a.k, coalesce(sum(p.n * pow(cast({PARAMS.alpha} as double), a.k - p.k)), 0) as prior, coalesce(sum(p.n), 0) as before
    from n a left join n p on a.feature = p.feature and a.h = p.h and a.b = p.b and p.k < a.k group by all),
pl as (select c.seq, c.k, c.feature, prior + rn as cur, before + rn as tot from (select *, row_number() over (partition by feature, h, b, k order by seq) as rn from cells) c join pr using (feature, h, b, k)),
es as (select seq, k, feature, min(cur) as cur, cast(min(tot) as double) as tot from pl group by all),
mm as (select *, greatest(tot / k, {PARAMS.beta}::double) as m from es),
qq as (select *, pow(greatest(cur - m, 0.0), 2) as q from mm),
s0 as (select seq, k, feature, cur, q / m + q / (m * greatest(k - 1, 1)) as s from qq),
sc as (select s0.seq, s0.k, feature, case when feature in ('user_code', 'type_code') and (cur <= {PARAMS.min_count} or (feature = 'type_code' and type_code = 0)) then 0.0
    when feature = 'record' and ign = 1 then 0.0 else s end as s from s0 join base using (seq))"""


_ALL = _kernel(_NORMAL, *map(_numeric_cell, NUMERIC), *map(_code_cells, CODES), _record_cells())
_ONE = "select seq, k, round(s, 6) as score from sc where feature = '{}'"
_FEATURES = ["record", *NUMERIC, *CODES]
_WIDE = f"{_ALL}, w as (select seq, k, {', '.join(f"coalesce(max(case when feature = '{f}' then s end), 0.0) as {f}" for f in _FEATURES)} from sc group by seq, k), ws as (select *, {' + '.join(_FEATURES)} as total from w)"
_CAT = _kernel(_PLAIN, _code_cells("user_code"))
_JOURNAL = f"{_CAT}, j as (select sc.seq, sc.k, feature, (user_code * {PARAMS.hashes[-1][0]} + {PARAMS.hashes[-1][1]}) % {_NB} as bucket, user_code as value, round(s, 6) as score from sc join base using (seq))"

SQL = {
    "score_categorical": f"{_CAT} {_ONE.format('user_code')}",
    "score_numeric_streaming": f"{_kernel(_NORMAL, _numeric_cell('m7'))} {_ONE.format('m7')}",
    "score_numeric_apriori": f"{_kernel(_APRIORI, _numeric_cell('value'))} {_ONE.format('value')}",
    "score_record": f"{_ALL} {_ONE.format('record')}",
    "score_combined": f"{_WIDE} select seq, k, round(ln(1 + total), 6) as score, {', '.join(f'round(ln(1 + {f}), 6) as {f}_score' for f in _FEATURES)} from ws",
    "score_shares": f"{_WIDE} select seq, {', '.join(f'round(case when total = 0 then 0.0 else {f} / total end, 6) as {f}_share' for f in _FEATURES)} from ws",
    "score_text_sink": f"{_WIDE} select seq, printf('%.5f', round(ln(1 + total), 5)) as line from ws",
    "bucket_journal": f"{_JOURNAL} select k, feature, bucket, count(*) as n, min(value) as first_value, round(sum(score), 6) as score_sum from j group by all",
    "bucket_stats": f"{_JOURNAL} select feature, count(distinct bucket) as used_buckets, count(distinct value) as unique_values, count(*) as frequency, count(distinct value) - count(distinct bucket) as surplus_values from j group by feature",
    "buckets_by_collisions": f"{_JOURNAL} select feature, bucket, count(distinct value) as collisions, count(*) as frequency from j group by all order by collisions desc, frequency desc, bucket limit 10",
    "bucket_active_at_step": f"{_JOURNAL} select bucket, count(*) as n, round(sum(score), 6) as score_sum, string_agg(cast(value as varchar), ',' order by value) as values from j where k = 20 group by bucket",
    "bucket_decode": f"{_JOURNAL} select bucket, 'user-' || (value - 1) as label, count(*) as n from j group by all",
    "bucket_dump_reader": f"{_JOURNAL} select k, bucket, value, score from j",
    "global_min_max": "select min(value) as min_value, max(value) as max_value, min(cast(event_id % 7 as double)) as min_m7, max(cast(event_id % 7 as double)) as max_m7 from events",
    "dense_timestep": f"with {_BASE} select seq, k from ck",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    score_categorical, score_numeric_streaming, score_numeric_apriori, score_record, score_combined, score_shares, score_text_sink, bucket_journal, bucket_stats,
    buckets_by_collisions, bucket_active_at_step, bucket_decode, bucket_dump_reader, global_min_max, dense_timestep)}
