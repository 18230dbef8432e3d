"""Running aggregates over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Rows of a chunk; sequence numbers are dense, so a chunk is known from its number.
CHUNK = 1 << 17
#: Ranges that an order without dense numbers is cut into at most.
RANGES = 10_000


def ordered_chunks(df: DataFrame, value: str) -> Column:
    """A column that numbers ranges of ``value`` in order, of about CHUNK rows each, nulls first; equal values share one.

    The bounds are read once, so that every use of the column agrees: at most RANGES numbers, whatever the size.
    """
    parts = min(RANGES, -(-df.count() // CHUNK))
    if parts < 2:
        return F.lit(0)
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 4 * RANGES).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    place = F.size(F.filter(F.lit(bounds), lambda b: b < F.col(value).cast("double")))
    return F.when(F.col(value).isNull(), -1).otherwise(place)


def running(df: DataFrame, seq: str, aggregates: dict[str, tuple[str, Column]], chunk: Column | None = None) -> DataFrame:
    """``df`` with running values over ``seq``, the row's own included: name -> (min | max | sum, column).

    Chunks of CHUNK consecutive numbers (or ``chunk``, for other orders) are scanned side by side; one row for
    each chunk is scanned in order and joined back.
    """
    combine = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}
    rows = df.withColumn("__chunk", F.floor(F.col(seq) / F.lit(CHUNK)) if chunk is None else chunk)
    totals = rows.groupBy("__chunk").agg(*[combine[kind][0](c).alias(f"__t_{name}") for name, (kind, c) in aggregates.items()])
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("__chunk").alias("__c"), *[combine[kind][0](f"__t_{name}").over(before).alias(f"__b_{name}") for name, (kind, _) in aggregates.items()])
    inside = Window.partitionBy("__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__i_{name}": combine[kind][0](c).over(inside) for name, (kind, c) in aggregates.items()})
    rows = rows.join(carried, rows["__chunk"] == carried["__c"])
    made = {name: combine[kind][1](F.col(f"__i_{name}"), F.col(f"__b_{name}")) for name, (kind, _) in aggregates.items()}
    return rows.withColumns(made).select(*df.columns, *aggregates)


def clocked(stream: DataFrame, seq: str = "seq", t: str = "t") -> DataFrame:
    """``stream`` with ``ct``, the running maximum of ``t``, and ``k``, the number of distinct ``ct`` so far.

    Written to the shared folder, since what follows reads it several times.
    """
    rows = materialize(running(stream, seq, {"ct": ("max", F.col(t))}))
    ranked = dense_numbers(rows.select("ct").distinct(), ["ct"], "k").withColumn("k", F.col("k") + 1)
    return materialize(rows.join(ranked, "ct").select(*stream.columns, "ct", "k"))


def dense_numbers(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """``df`` with dense numbers from 0 in the order given, which must be total; the first column is a number or time.

    ``df`` is written to the shared folder first, since its ranges, their counts and its rows are read in turn.
    Ranges of the first column are counted and only these counts are scanned in order; a row's place within
    its range comes from a window over the range.
    """
    head = "__order"
    rows = materialize(df.withColumn(head, F.unix_micros(F.col(order[0]).cast("timestamp")) if df.schema[order[0]].dataType.typeName().startswith("timestamp") else F.col(order[0])))
    rows = rows.withColumn("__chunk", ordered_chunks(rows, head))
    counts = rows.groupBy("__chunk").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__chunk").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__chunk").orderBy(*order)) - 1
    rows = rows.withColumn("__place", place).join(starts, F.col("__chunk") == F.col("__c"))
    return rows.withColumn(name, (F.col("__start") + F.col("__place")).cast("long")).drop(head, "__chunk", "__c", "__start", "__place")
