"""Queries on time series, encodings and evaluation, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timebuckets import ceil_bucket, epoch_millis, epoch_seconds, floor_bucket, record_timestep
from ..operators import encode as E
from ..operators import evaluate as V
from ..operators import series as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a function of (events, spark, sf_dir)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/events.parquet"), spark, sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text_time(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _ceil(s: int) -> str:
    return f"cast(ceil(epoch_us(ts) / {s}000000.0) as bigint) * {s}"


def _time(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%d %H:%M:%S')"


@query(f"""select {_time(_ceil(1800))} as bucket, count(*) as n, round(sum(value), 6) as total, max(value) as top, bool_or(event_type = 'error') as has_error
from events group by 1""")
def series_30min(events: DataFrame, *_) -> DataFrame:
    rows = S.bucketed(events, "ts", 1800, F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("top"), F.bool_or(F.col("event_type") == "error").alias("has_error"))
    return rows.withColumn("bucket", text_time("bucket"))


@query("""with b as (select epoch_us(ts) // 3600000000 as b, count(*) as n from events group by 1), s as (select unnest(range(min(b), max(b) + 1)) as b from b)
select strftime(make_timestamp(s.b * 3600000000), '%Y-%m-%d %H:%M:%S') as bucket, coalesce(n, 0) as total from s left join b using (b)""")
def series_resample_sum(events: DataFrame, *_) -> DataFrame:
    rows = S.resampled_sum(events.withColumn("one", F.lit(1).cast("long")), "ts", "one", 3600)
    return rows.withColumn("bucket", text_time("bucket"))


@query(f"""select {_time(_ceil(21600))} as bucket, count(*) as n, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type in ('click', 'view')) as passive,
count(*) - count(*) filter (event_type = 'error') - count(*) filter (event_type in ('click', 'view')) as active from events group by 1""")
def series_conditional_counts(events: DataFrame, *_) -> DataFrame:
    passive = F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("event_type"))
    rows = S.bucketed(events, "ts", 21600, F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(passive).alias("passive"))
    return rows.withColumn("active", F.col("n") - F.col("errors") - F.col("passive")).withColumn("bucket", text_time("bucket"))


@query(f"""with a as (select {_ceil(21600)} as b, count(*) as volume from events group by 1), e as (select {_ceil(21600)} as b, count(*) as errors from events where event_type = 'error' and value > 60 group by 1)
select {_time('a.b')} as bucket, volume, cast(errors as double) as errors from a left join e using (b)""")
def series_volume_left_join(events: DataFrame, *_) -> DataFrame:
    volume = S.bucketed(events, "ts", 21600, F.count("*").alias("volume"))
    errors = S.bucketed(events.where("event_type = 'error' and value > 60"), "ts", 21600, F.count("*").cast("double").alias("errors"))
    return volume.join(errors, "bucket", "left").withColumn("bucket", text_time("bucket"))


@query(f"""with b as (select {_ceil(21600)} as b, user_id from events), f as (select user_id, min(b) as b from b group by 1), n as (select b, count(*) as new from f group by 1)
select {_time('s.b')} as bucket, cast(sum(coalesce(new, 0)) over (order by s.b) as bigint) as seen from (select distinct b from b) s left join n using (b)""")
def series_running_distinct(events: DataFrame, *_) -> DataFrame:
    rows = S.running_distinct(events.withColumn("b", ceil_bucket(F.col("ts"), 21600)), "b", "user_id")
    return rows.withColumn("bucket", text_time("bucket"))


@query("""select event_id, strftime(make_timestamp((epoch_us(ts) // 1800000000) * 1800000000), '%Y-%m-%d %H:%M:%S') as floor_bucket, epoch_us(ts) // 1000000 as epoch_s, epoch_us(ts) // 1000 as epoch_ms,
cast(floor((epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) over ()) / 1800) as bigint) as timestep from events""")
def clock_values(events: DataFrame, *_) -> DataFrame:
    first = events.agg(F.min(epoch_seconds(F.col("ts"))).alias("s")).first()["s"]
    return events.select("event_id", text_time(floor_bucket(F.col("ts"), 1800)).alias("floor_bucket"), epoch_seconds(F.col("ts")).alias("epoch_s"), epoch_millis(F.col("ts")).alias("epoch_ms"),
                         record_timestep(epoch_seconds(F.col("ts")), F.lit(first), 1800).alias("timestep"))


@query("""select event_id, strftime(ts + interval 1 month, '%Y-%m-%d') as next_month, strftime(ts - interval 7 day, '%Y-%m-%d') as week_before, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as iso from events""")
def relative_dates(events: DataFrame, *_) -> DataFrame:
    day = F.to_date("ts")
    return events.select("event_id", F.date_format(F.add_months(day, 1), "yyyy-MM-dd").alias("next_month"), F.date_format(F.date_add(day, -7), "yyyy-MM-dd").alias("week_before"),
                         F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("iso"))


@query("""select count(*) as n, count(distinct user_id) as users, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day from events""")
def dataset_summary(events: DataFrame, *_) -> DataFrame:
    return events.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("select event_type, count(*) as n from events group by 1")
def value_counts(events: DataFrame, *_) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("""select s.slice, count(*) as n from (select unnest(range(0, cast(ceil(count(*) / 150) as bigint))) as slice from events) s join events e on e.event_id >= s.slice * 150 and e.event_id < s.slice * 150 + 400 group by 1""")
def sliding_slices(events: DataFrame, *_) -> DataFrame:
    return S.sliding_slices(events, "event_id", 400, 150, -(-events.count() // 150)).groupBy(F.col("slice").cast("long").alias("slice")).agg(F.count("*").alias("n"))


@query("""with t as (select event_type, count(*) as n from events group by 1 order by 2 desc, 1 limit 3), r as (select event_type, row_number() over (order by n desc, event_type) as i from t)
select """ + _time(_ceil(21600)) + """ as bucket, count(*) as total, count(*) filter (i = 1) as top1, count(*) filter (i = 2) as top2, count(*) filter (i = 3) as top3 from events left join r using (event_type) group by 1""")
def top3_entity_series(events: DataFrame, *_) -> DataFrame:
    return S.top_values_series(events, "ts", "event_type", 21600).withColumn("bucket", text_time("bucket"))


_FIT = f"""with s as (select event_type, cast({_ceil(21600)} - 1704067200 as double) / 21600 as x, cast(count(*) as double) as y from events group by 1, 2),
f as (select event_type, regr_slope(y, x) as sl, regr_intercept(y, x) as ic from s group by 1), r as (select s.*, y - (sl * x + ic) as res from s join f using (event_type)), d as (select event_type, stddev_samp(res) as sd from r group by 1)"""


@query(f"{_FIT} select event_type, cast(x as bigint) as step, round(case when sd > 1e-9 then res / sd else 0 end, 6) as anomaly, case when sd > 1e-9 then res / sd > 1.5 else false end as is_anomaly from r join d using (event_type)")
def forecast_linear_anomaly(events: DataFrame, *_) -> DataFrame:
    rows = S.linear_anomaly(_series(events), "event_type", "x", "y")
    return rows.select("event_type", F.col("x").cast("long").alias("step"), F.round("anomaly", 6).alias("anomaly"), (F.col("anomaly") > 1.5).alias("is_anomaly"))


@query(f"""{_FIT}, w as (select event_type, ((cast(floor(x / 4) as bigint) % 7) + 7) % 7 as wd, avg(res) as usual from r group by 1, 2),
rw as (select r.event_type, x, res - usual as res from r join w on r.event_type = w.event_type and ((cast(floor(x / 4) as bigint) % 7) + 7) % 7 = wd), dw as (select event_type, stddev_samp(res) as sd from rw group by 1)
select event_type, cast(x as bigint) as step, round(case when sd > 1e-9 then res / sd else 0 end, 6) as anomaly from rw join dw using (event_type)""")
def forecast_weekly_anomaly(events: DataFrame, *_) -> DataFrame:
    """Trend and day of the week."""
    rows = S.linear_anomaly(_series(events), "event_type", "x", "y", F.pmod(F.floor(F.col("x") / 4), F.lit(7)))
    return rows.select("event_type", F.col("x").cast("long").alias("step"), F.round("anomaly", 6).alias("anomaly"))


def _series(events: DataFrame) -> DataFrame:
    x = ((epoch_seconds(ceil_bucket(F.col("ts"), 21600)) - 1704067200).cast("double") / 21600).alias("x")
    return events.groupBy("event_type", x).agg(F.count("*").cast("double").alias("y"))


_HITS = "with h as (select user_id, event_id, value > 60 as hit from events), e as (select *, hit and not coalesce(lag(hit) over (partition by user_id order by event_id), false) as starts from h)"


@query(f"{_HITS} select user_id, count(*) filter (starts) as spikes from e group by 1")
def spike_runs(events: DataFrame, *_) -> DataFrame:
    return S.spike_runs(events, "user_id", "event_id", "value", 60)


@query("""with r as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as run from events)
select event_id, round(sum(value) over (partition by user_id, run order by event_id rows unbounded preceding), 6) as running from r""")
def cumulative_reset(events: DataFrame, *_) -> DataFrame:
    rows = S.cumulative_with_reset(events.withColumn("reset", F.col("event_type") == "signup"), "user_id", "event_id", "value", "reset")
    return rows.select("event_id", F.round("running", 6).alias("running"))


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows 4 preceding), 6) as rolling from events")
def rolling_average(events: DataFrame, *_) -> DataFrame:
    return S.rolling_average(events, "user_id", "event_id", "value", 5).select("event_id", F.round("rolling", 6).alias("rolling"))


@query("select event_id, min(value) over (order by event_id rows unbounded preceding) as low, max(value) over (order by event_id rows unbounded preceding) as high from events")
def running_bounds(events: DataFrame, *_) -> DataFrame:
    return S.running_bounds(events.select("event_id", "value"), "event_id", "value").select("event_id", "low", "high")


@query("select event_id, coalesce(value > 1.5, false) as is_anomaly, case when event_type = 'view' then 0 else 1 end as label from events")
def threshold_flags(events: DataFrame, *_) -> DataFrame:
    return events.select("event_id", F.coalesce(F.col("value") > 1.5, F.lit(False)).alias("is_anomaly"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("label"))


# encoding


@query("select user_id, row_number() over (order by min(event_id), user_id) as code from events group by user_id")
def first_seen_codes(events: DataFrame, *_) -> DataFrame:
    return E.first_seen_codes(events, "user_id", "event_id")


@query("select event_id, case when row_number() over (partition by user_id order by event_id) > 1 then 1 else 0 end as ignore from events")
def ignore_flags(events: DataFrame, *_) -> DataFrame:
    return E.ignore_flags(events, "user_id", "event_id").select("event_id", "ignore")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1")
def dedup_keep_first(events: DataFrame, *_) -> DataFrame:
    return E.keep_first(events, "user_id", "event_id").select("event_id", "user_id")


@query("""with d as (select doc_id, string_split(text, ' ') as words, [source] as sources from documents)
select doc_id, aspect, position, word, source from (
select doc_id, 0 as aspect, unnest(range(0, len(words))) as position, unnest(words) as word, null as source from d
union all select doc_id, 1, 0, null, source from documents)""")
def explode_union(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = E.explode_union(docs, ["doc_id"], {"word": F.split("text", " "), "source": F.array("source")})
    return rows.withColumn("position", F.col("position").cast("long"))


@query("""with r as (select conv_id * 100 + turn as id, case when turn > 0 and conv_id % 2 = 0 then conv_id * 100 end as orig, text from conversations),
n as (select *, row_number() over (partition by coalesce(orig, id) order by id) as rn from r)
select id, case when orig is not null and rn > 1 then '' else text end as text from n""")
def retweet_text_suppression(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when((F.col("turn") > 0) & (F.col("conv_id") % 2 == 0), F.col("conv_id") * 100).alias("orig"), "text")
    return E.suppress_repeated_text(rows, "id", "orig", "text", "id").select("id", "text")


@query("select event_id, md5('7:' || event_id) as h from events order by h, event_id limit 500")
def hash_sample(events: DataFrame, *_) -> DataFrame:
    return E.hash_sample(events, "event_id", 500, 7).select("event_id", F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary")).alias("h"))


@query("select chunk, count(*) as n, min(event_id) as first from (select *, event_id // 100 as chunk from events) group by 1")
def chunking(events: DataFrame, *_) -> DataFrame:
    return E.chunked(events, "event_id", 100).groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


# evaluation; the label of an event is that it is an error, its score a mix of value and id


def _labelled(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", (F.col("event_type") == "error").alias("label"), F.floor("value").alias("score"))


_LAB = "with l as (select event_id, user_id, event_type = 'error' as label, cast(floor(value) as bigint) as score from events)"
_AUC = """, c as (select {g} score, count(*) filter (label) as p, count(*) filter (not label) as n from l group by all),
w as (select *, p * (coalesce(sum(n) over ({pg} order by score rows between unbounded preceding and 1 preceding), 0) + n / 2) as wins from c)
select {g} round(sum(wins) / case when sum(p) * sum(n) > 0 then sum(p) * sum(n) end, 6) as auc from w {gb}"""


@query(_LAB + _AUC.format(g="", pg="", gb=""))
def auc(events: DataFrame, *_) -> DataFrame:
    return V.auc(_labelled(events), "score", "label").select(F.round("auc", 6).alias("auc"))


@query("with l as (select event_id // 50 as win, event_type = 'error' as label, cast(floor(value) as bigint) as score from events)" + _AUC.format(g="win,", pg="partition by win", gb="group by win"))
def auc_windowed(events: DataFrame, *_) -> DataFrame:
    rows = _labelled(events).withColumn("win", F.floor(F.col("event_id") / 50))
    return V.auc(rows, "score", "label", "win").select("win", F.round("auc", 6).alias("auc"))


_TOP = _LAB + ", r as (select *, row_number() over (order by score desc, event_id) as rn from l), t as (select *, rn <= (select count(*) filter (label) from l) as predicted from r)"


@query(f"{_TOP} select event_id, predicted from t")
def topn_predictions(events: DataFrame, *_) -> DataFrame:
    return V.top_n_predictions(_labelled(events), "score", "label", "event_id").select("event_id", "predicted")


@query(f"""{_TOP}, c as (select count(*) filter (predicted and label) as h, count(*) filter (predicted) as p, count(*) filter (label) as t from t)
select round(h / p, 6) as precision, round(h / t, 6) as recall, round(2 * h / (p + t), 6) as f1 from c""")
def precision_recall_f1(events: DataFrame, *_) -> DataFrame:
    rows = V.precision_recall_f1(V.top_n_predictions(_labelled(events), "score", "label", "event_id"), "predicted", "label")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@query("""with r as (select user_id, round(sum(value), 6) as value, round(sum(cast(event_id % 7 as double)), 6) as m7, bool_or(event_type = 'error') as flag from events group by 1)
select user_id, value, m7, flag, round(value + m7, 6) as total, round(value / (value + m7), 6) as value_share, round(m7 / (value + m7), 6) as m7_share from r""")
def tweet_rollup(events: DataFrame, *_) -> DataFrame:
    rows = events.select("user_id", "value", (F.col("event_id") % 7).cast("double").alias("m7"), (F.col("event_type") == "error").alias("flag"))
    out = V.rollup(rows, "user_id", ["value", "m7"], "flag")
    return out.select("user_id", "flag", *[F.round(c, 6).alias(c) for c in ("value", "m7", "total", "value_share", "m7_share")])


@query("select event_id, round(avg(value) over (partition by user_id), 6) as value from events")
def score_handling_mean(events: DataFrame, *_) -> DataFrame:
    return V.group_value(events, "user_id", "value", "mean").select("event_id", F.round("value", 6).alias("value"))


@query("select event_id, max(value) over (partition by user_id) as value from events")
def score_handling_max(events: DataFrame, *_) -> DataFrame:
    return V.group_value(events, "user_id", "value", "max").select("event_id", "value")


@query("select event_type, event_id // 1000 as step, max(value) as top, max(event_id % 7) as top7 from events group by 1, 2")
def group_max(events: DataFrame, *_) -> DataFrame:
    return events.groupBy("event_type", F.floor(F.col("event_id") / 1000).alias("step")).agg(F.max("value").alias("top"), F.max(F.col("event_id") % 7).alias("top7"))


_MID = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2"


@query(f"with d as (select n_chars as a, quality as b from labels join documents using (doc_id)), r as (select {_MID.format('a')} as ra, {_MID.format('b')} as rb from d) select round(corr(ra, rb), 6) as spearman from r")
def spearman(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return V.spearman(rows.select("n_chars", "quality"), "n_chars", "quality").select(F.round("spearman", 6).alias("spearman"))
