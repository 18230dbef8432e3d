"""Queries on the star schema: joins, sets, bins, rounding, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import relational as R

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a function of (table reader)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select c_custkey, c_custkey not in (select o_custkey from orders) as missing from customer")
def missing_references(t) -> DataFrame:
    return R.missing_references(t("customer"), "c_custkey", t("orders"), "o_custkey").select("c_custkey", "missing")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join_lookup(t) -> DataFrame:
    chosen = t("customer").where("c_mktsegment = 'BUILDING'")
    return t("orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select distinct l_suppkey from lineitem where l_quantity < 3 and l_suppkey not in (select s_suppkey from supplier where s_acctbal > 5000)")
def anti_join_distinct(t) -> DataFrame:
    return R.set_difference(t("lineitem").where("l_quantity < 3").select("l_suppkey"), t("supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")))


@query("with s as (select o_custkey, round(sum(o_totalprice), 2) as spent from orders where o_orderstatus = 'F' group by 1) select c_custkey, coalesce(spent, 0) as spent, n_name from customer left join s on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def lookup_default(t) -> DataFrame:
    spent = t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = R.lookup(t("customer"), "c_custkey", spent, "o_custkey", {"spent": 0.0})
    return R.lookup(rows, "c_nationkey", t("nation").select("n_nationkey", "n_name"), "n_nationkey", {"n_name": None}).select("c_custkey", "spent", "n_name")


@query("with s as (select l_orderkey, round(sum(l_quantity), 2) as score from lineitem where l_returnflag = 'R' group by 1) select o_orderkey, o_orderstatus, score from orders left join s on l_orderkey = o_orderkey")
def scores_left_join(t) -> DataFrame:
    scores = t("lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return t("orders").join(scores, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "score")


@query("with a as (select o_orderkey, row_number() over (order by o_orderkey) as seq from orders), b as (select o_totalprice, row_number() over (order by o_orderkey) as seq from orders) select o_orderkey, o_totalprice from a join b using (seq)")
def positional_zip(t) -> DataFrame:
    orders = t("orders")
    return R.zipped(orders.select("o_orderkey"), orders.select("o_orderkey", "o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select c_custkey as key, c_acctbal as acctbal from customer union all select s_suppkey, s_acctbal from supplier")
def union_common_columns(t) -> DataFrame:
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    b = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"), "s_name")
    return R.union_common(a, b)


@query("""with e as (select quantile_cont(c_acctbal, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as q from customer)
select len(list_filter(q, lambda x: x < c_acctbal)) as bin, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high from customer, e group by 1""")
def quantile_bins(t) -> DataFrame:
    return R.quantile_bins(t("customer"), "c_acctbal", 8).groupBy("bin").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("""with m as (select min(p_retailprice) as lo, (max(p_retailprice) - min(p_retailprice)) / 10 as w from part)
select cast(greatest(ceil(round((p_retailprice - lo) / w, 9)) - 1, 0) as bigint) as bin, count(*) as n from part, m group by 1""")
def equal_width_bins(t) -> DataFrame:
    return R.equal_width_bins(t("part"), "p_retailprice", 10).groupBy("bin").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def nlargest(t) -> DataFrame:
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_mktsegment from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 100")
def sort_head(t) -> DataFrame:
    return t("customer").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey", "c_mktsegment")


_S = "s_acctbal - 4000.5"


@query(f"""select s_suppkey, case when abs(({_S}) * 10) - abs(floor(({_S}) * 10)) < 0.5 then floor(({_S}) * 10) else ceil(({_S}) * 10) end / 10 as rounded from supplier""")
def c_round(t) -> DataFrame:
    return t("supplier").select("s_suppkey", N.half_up(F.col("s_acctbal") - 4000.5, 1).alias("rounded"))


_R = "case when abs(l_discount * l_quantity) > 10 then round(l_discount * l_quantity, 4) else round(l_discount * l_quantity, 5) end"


@query(f"with r as (select l_orderkey, l_linenumber, {_R} as r from lineitem) select l_orderkey, l_linenumber, case when r = floor(r) then cast(cast(r as bigint) as varchar) else cast(r as varchar) end as key from r")
def umap_key(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", N.short_key(F.col("l_discount") * F.col("l_quantity")).alias("key"))


@query("select c_custkey, round(log10(1 + abs(c_acctbal)), 6) as log10p, round(ln(1 + abs(c_acctbal)), 6) as log1p, round(case when c_acctbal > 0 then ln(c_acctbal) else 0 end, 6) as guarded, round(pow(c_nationkey, 2), 6) as squared from customer")
def numeric_logs(t) -> DataFrame:
    x = F.col("c_acctbal")
    return t("customer").select("c_custkey", F.round(F.log10(1 + F.abs(x)), 6).alias("log10p"), F.round(F.log1p(F.abs(x)), 6).alias("log1p"), F.round(N.guarded_log(x), 6).alias("guarded"), F.round(F.pow("c_nationkey", F.lit(2)), 6).alias("squared"))


@query("select count(*) filter (spent is null) as without, count(*) filter (spent is not null) as with_orders from customer left join (select o_custkey, sum(o_totalprice) as spent from orders group by 1) on o_custkey = c_custkey")
def null_split(t) -> DataFrame:
    spent = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    rows = t("customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.agg(F.count_if(F.col("spent").isNull()).alias("without"), F.count_if(F.col("spent").isNotNull()).alias("with_orders"))


@query("select o_orderkey from orders where o_orderdate between timestamp '1995-01-01' and timestamp '1995-06-30'")
def range_filter(t) -> DataFrame:
    return t("orders").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-06-30").cast("timestamp_ntz"))).select("o_orderkey")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity <= 5 and l_discount >= 0.05 and l_extendedprice >= 1000")
def conjunctive_filter(t) -> DataFrame:
    return t("lineitem").where("l_quantity <= 5 and l_discount >= 0.05 and l_extendedprice >= 1000").select("l_orderkey", "l_linenumber")


@query("select o_orderkey, cast(o_orderkey as varchar) as id, cast(round(o_totalprice) as bigint) as price, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def casts(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.round("o_totalprice").cast("long").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""with k as (select c_mktsegment as s, row_number() over (order by count(*) desc, c_mktsegment) as i from customer group by 1)
select c_nationkey, count(*) filter (i = 1) as "top1", count(*) filter (i = 2) as "top2" from customer join k on s = c_mktsegment group by 1""")
def dynamic_columns(t) -> DataFrame:
    names = [r["c_mktsegment"] for r in t("customer").groupBy("c_mktsegment").count().orderBy(F.desc("count"), "c_mktsegment").limit(2).collect()]
    counts = t("customer").groupBy("c_nationkey").agg(*[F.count_if(F.col("c_mktsegment") == v).alias(f"#{v}") for v in names])
    return R.renamed(counts, {f"#{v}": f"top{i}" for i, v in enumerate(names, 1)})


@query("""select event_id, case when day(ts) % 10 = 0 then 'aaaa' when day(ts) % 5 = 0 then 'bbbb' else '' end as planted from events""")
def synthetic_stream(t) -> DataFrame:
    from ..sources.synthetic import planted_text

    return t("events").select("event_id", planted_text(F.col("ts"), "aaaa", "bbbb", F.lit("")).alias("planted"))
