"""Anomaly scores of a record stream: decayed against undecayed frequency sketches, as windows and aggregates.

A sketch cell only ever has 1 added or is multiplied by alpha, both linear, so cells are independent once the
step of each record is known: what the sequential loop holds for a cell when a record arrives is the decayed sum
of the cell's counts in earlier steps plus the record's place in its own step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import scan
from ..params import ScorerParams
from ..tables import materialize
from .prefix import CHUNK, clocked, running

#: Cells are told apart by these; side 0 is the decayed sketch (and the total's too unless hashes differ).
CELL = ("feature", "side", "hash_row", "bucket")


def surprise(total: Column, current: Column, t: Column, beta: float) -> Column:
    """How far ``current`` exceeds the mean rate ``total / t``, never below 0; 0 at t = 0."""
    t = t.cast("double")
    mean = F.greatest(F.try_divide(total.cast("double"), t), F.lit(float(beta)))
    over = F.pow(F.greatest(current - mean, F.lit(0.0)), F.lit(2.0))
    score = F.try_divide(over, mean) + F.try_divide(over, mean * F.greatest(t - 1, F.lit(1.0)))
    return F.when(t <= 0, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))


def normalised(stream: DataFrame, columns: list[str], params: ScorerParams, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """``stream`` with ``v_<column>`` in [0, 1] for each numeric column: log10(1 + x) between its bounds.

    Streaming bounds are those of the non-zero values so far, the row's own included; a value of 0 has no v.
    ``bounds`` are the logs that earlier batches of a stream left. A-priori bounds are those of all values.
    Rounded to 12 places, so that a bucket's edge is one.
    """
    logs = {c: F.log10(1 + F.col(c)) for c in columns}
    if params.normaliser == "streaming":
        left = lambda c, k: F.lit((bounds or {}).get(c, (None, None))[k]).cast("double")
        seen = {c: F.when(F.col(c) != 0, x) for c, x in logs.items()}
        ends = {f"lo_{c}": ("min", F.least(x, left(c, 0))) for c, x in seen.items()} | {f"hi_{c}": ("max", F.greatest(x, left(c, 1))) for c, x in seen.items()}
        rows = running(stream, "seq", ends)
    else:
        ends = stream.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
        low = {c: F.lit(ends[f"lo_{c}"]).cast("double") for c in columns}
        rows = stream.withColumns({f"hi_{c}": F.log10(1 + F.lit(ends[f"hi_{c}"]).cast("double")) for c in columns})
        rows = rows.withColumns({f"lo_{c}": low[c] if params.compat else F.log10(1 + low[c]) for c in columns})
    made = {
        f"v_{c}": F.when(F.col(c) == 0, F.lit(None).cast("double") if params.normaliser == "streaming" else F.lit(0.0))
        .when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), F.lit(0.0))
        .otherwise(F.round((logs[c] - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")), 12))
        for c in columns
    }
    return rows.withColumns(made).drop(*[f"{e}_{c}" for c in columns for e in ("lo", "hi")])


def numeric_bucket(v: Column, buckets: int) -> Column:
    return F.pmod(F.floor(v * (buckets - 1)), F.lit(buckets)).cast("long")


def code_bucket(code: Column, a: int, b: int, buckets: int) -> Column:
    return F.pmod(code * a + b, F.lit(buckets)).cast("long")


def record_bucket(values: list[Column], codes: list[Column], row: int, params: ScorerParams) -> Column:
    """Sign bits of the numeric vector, lowest first, plus the linear hashes of the codes, modulo the buckets."""
    total = F.lit(0)
    if values:
        for bit in range(params.bits):
            plane = params.plane(row, bit, len(values))
            dot = reduce(lambda x, y: x + y, [v * F.lit(p) for v, p in zip(values, plane)])
            total = total + F.when(dot >= 0, F.lit(1 << bit)).otherwise(F.lit(0))
    for j, code in enumerate(codes):
        a, b = params.linear()[row]
        total = total + F.pmod(code * (a + 2 * j) + b, F.lit(params.buckets))
    return F.pmod(total, F.lit(params.buckets)).cast("long")


def cells(stream: DataFrame, numeric: list[str], categorical: list[str], params: ScorerParams, record: bool = True) -> DataFrame:
    """(seq, k, ct, feature, side, hash_row, bucket, void): the cells each record adds to.

    A number has one exact histogram row and none for a raw 0; a code has one cell for each sketch row; the
    record always has one for each sketch row. A void feature scores 0: a code of 0, an ignored record.
    """
    never = F.lit(False)
    made = [F.when(F.col(c) != 0, _cell(c, 0, 0, numeric_bucket(F.col(f"v_{c}"), params.buckets), never)) for c in numeric]
    sides = [params.linear()] + ([params.total_hashes] if params.total_hashes else [])
    made += [_cell(c, s, r, code_bucket(F.col(c), a, b, params.buckets), F.col(c) == 0) for c in categorical for s, hashes in enumerate(sides) for r, (a, b) in enumerate(hashes)]
    if record:
        values = [F.coalesce(F.col(f"v_{c}"), F.lit(0.0)) for c in numeric]
        ignored = F.coalesce(F.col("ignore") == 1, never) if "ignore" in stream.columns else never
        made += [_cell("record", 0, r, record_bucket(values, [F.col(c) for c in categorical], r, params), ignored) for r in range(params.rows)]
    rows = stream.select("seq", "k", "ct", F.explode(F.array_compact(F.array(*made))).alias("cell"))
    return rows.select("seq", "k", "ct", "cell.*")


def _cell(feature: str, side: int, row: int, bucket: Column, void: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), F.lit(side).alias("side"), F.lit(row).alias("hash_row"), bucket.alias("bucket"), void.alias("void"))


def histories(counted: DataFrame, alpha: float, state: DataFrame | None = None) -> DataFrame:
    """(cell, k, new, prior, before, decayed, total): what a cell held when its part of step k began and ended.

    ``counted`` has the (cell, k, n) of the steps in which a cell was met; ``state`` the (cell, k, decayed, total)
    that earlier batches left. A cell's steps are folded in order, decaying by the steps between.
    """
    entries = counted.select(*CELL, "k", F.lit(1).alias("new"), F.col("n").cast("double").alias("d"), F.col("n").alias("n"))
    if state is not None:  # may end in the step that goes on
        entries = entries.unionByName(state.select(*CELL, "k", F.lit(0).alias("new"), F.col("decayed").alias("d"), F.col("total").alias("n")))
    grouped = entries.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("k", "new", "d", "n"))).alias("steps"))
    decay = lambda s, x: s["d"] * F.pow(F.lit(alpha), (x["k"] - s["k"]).cast("double"))
    moved = scan(
        F.col("steps"),
        F.struct(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(x["k"].alias("k"), (decay(s, x) + x["d"]).alias("d"), (s["n"] + x["n"]).alias("n")),
        lambda s, x: F.struct(x["k"].alias("k"), x["new"].alias("new"), decay(s, x).alias("prior"), s["n"].alias("before"), (decay(s, x) + x["d"]).alias("decayed"), (s["n"] + x["n"]).alias("total")),
        "array<struct<k:bigint,new:int,prior:double,before:bigint,decayed:double,total:bigint>>",
    )
    rows = grouped.select(*CELL, moved.alias("moved"))
    return rows.select(*CELL, F.explode("moved").alias("m")).select(*CELL, "m.*")


def estimates(cells_: DataFrame, params: ScorerParams, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((seq, feature, ct, k, void, current, total), histories): count-min estimates of each record's features.

    Only a record's place within its cell and step needs an order. It is counted in two levels, by chunks of
    sequence numbers and within them, so a hot cell is split by step and chunk.
    """
    chunk = [*CELL, "k", "chunk"]
    rows = cells_.withColumn("chunk", F.floor(F.col("seq") / F.lit(CHUNK)))
    parts = rows.groupBy(*chunk).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*CELL, "k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*chunk, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    told = histories(parts.groupBy(*CELL, "k").agg(F.sum("n").alias("n")), params.alpha, state)
    starts = starts.join(told.where("new = 1").select(*CELL, "k", "prior", "before"), [*CELL, "k"])
    inside = F.row_number().over(Window.partitionBy(*chunk).orderBy("seq"))
    rows = rows.withColumn("inside", inside).join(starts, chunk).withColumn("place", F.col("start") + F.col("inside"))
    current, total = F.col("prior") + F.col("place"), F.col("before") + F.col("place")
    decayed_side = total_side = F.col("side") == 0
    if params.total_hashes is not None:  # numbers and records have one side only
        single = cells_.groupBy("feature").agg(F.max("side").alias("sides")).where("sides = 0")
        total_side = (F.col("side") == 1) | F.col("feature").isin([r["feature"] for r in single.collect()])
    least = rows.groupBy("seq", "ct", "k", "feature").agg(
        F.max("void").alias("void"), F.min(F.when(decayed_side, current)).alias("current"), F.min(F.when(total_side, total)).alias("total")
    )
    return least, told


def feature_scores(
    stream: DataFrame, numeric: list[str], categorical: list[str], params: ScorerParams, record: bool = True, state: DataFrame | None = None,
    bounds: dict[str, tuple[float | None, float | None]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """((seq, k, feature, score), histories). Zero codes, codes too rare, and ignored records score 0.

    ``state`` and ``bounds`` are what earlier batches of a stream left.
    """
    rows = stream if not numeric else materialize(normalised(stream, numeric, params, bounds))
    found, told = estimates(cells(rows, numeric, categorical, params, record), params, state)
    t = F.col("k") if params.time_mode == "step" else F.col("ct")
    rare = F.col("feature").isin(categorical) & (F.col("current") <= params.min_count) if categorical else F.lit(False)
    score = F.when(F.coalesce("void", F.lit(False)) | rare, F.lit(0.0)).otherwise(surprise(F.col("total"), F.col("current"), t, params.beta))
    return found.select("seq", "k", "feature", score.alias("score")), told


def score(stream: DataFrame, numeric: list[str], categorical: list[str], params: ScorerParams | None = None) -> DataFrame:
    """(seq, k, score, <feature>_score, <feature>_share): log scores and shares of the record and its features.

    ``stream`` has a dense ``seq``, a time ``t``, the named columns and perhaps ``ignore``; all that is needed of
    order is in ``seq``. A late record counts in the step that is running. An empty stream gives no rows.
    """
    params = params or ScorerParams()
    if not numeric and not categorical:
        raise ValueError("at least one feature is needed")
    return combined(feature_scores(clocked(stream), numeric, categorical, params)[0], ["record", *numeric, *categorical])


def combined(scores: DataFrame, features: list[str]) -> DataFrame:
    """One row for each record from (seq, k, feature, score)."""
    rows = scores.groupBy("seq", "k").agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("score"))), F.lit(0.0)).alias(f) for f in features])
    total = reduce(lambda x, y: x + y, [F.col(f) for f in features])
    rows = rows.withColumn("__sum", total)
    logs = [F.log1p(f).alias(f"{f}_score") for f in features]
    shares = [F.when(F.col("__sum") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(f), F.col("__sum"))).alias(f"{f}_share") for f in features]
    return rows.select("seq", "k", F.log1p("__sum").alias("score"), *logs, *shares)
