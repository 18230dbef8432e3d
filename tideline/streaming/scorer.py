"""The scorer over a stream: each micro-batch continues from the state that the batches before left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scorer as S
from ..operators.encode import keep_first
from ..operators.prefix import dense_numbers, running
from ..params import ScorerParams
from ..tables import materialize, run_dir

STATE = "feature string, side int, hash_row int, bucket long, k long, decayed double, total long"
BOUNDS = "feature string, low double, high double"


class StreamScorer:
    """Scores micro-batches in ``foreachBatch``; the result equals that of one batch over all records.

    State is three small tables in ``folder``, which driver and executors must share: the cells met so far with
    the step, decayed and total counts they were left with (at most features x rows x buckets of them), the
    clock, and the bounds of the logs of each number. All are written by batch number, so a batch that is tried
    again starts from the same state. Numbers are normalised by the bounds so far.
    """

    def __init__(self, spark: SparkSession, categorical: list[str], params: ScorerParams, folder: str, record: bool = False, numeric: list[str] | None = None):
        if numeric and params.normaliser != "streaming":
            raise ValueError("a stream has no bounds known beforehand")
        self.spark, self.categorical, self.params, self.folder, self.record = spark, categorical, params, folder.rstrip("/"), record
        self.numeric = list(numeric or [])

    def _read(self, name: str, batch: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}-{batch}") if batch >= 0 else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}-{batch}")

    def _clock(self, batch: int) -> tuple[int | None, int]:
        row = self._read("clock", batch, "ct long, k long").first()
        return (row["ct"], row["k"]) if row else (None, 0)

    def _bounds(self, batch: int) -> dict[str, tuple[float | None, float | None]]:
        return {r["feature"]: (r["low"], r["high"]) for r in self._read("bounds", batch, BOUNDS).collect()}  # one row a feature

    def score_batch(self, rows: DataFrame, batch: int) -> None:
        """Scores ``rows`` (seq, t, features, perhaps ignore) and leaves scores-, cells-, clock- and bounds-<batch>."""
        ct, k = self._clock(batch - 1)
        state = self._read("cells", batch - 1, STATE)
        bounds = self._bounds(batch - 1) if self.numeric else {}
        before = F.lit(ct).cast("long")
        timed = materialize(running(rows, "seq", {"ct": ("max", F.greatest(F.col("t"), before))}))
        steps = timed.select("ct").distinct().where(before.isNull() | (F.col("ct") > before))
        ranked = dense_numbers(steps, ["ct"], "__k").select(F.col("ct").alias("__ct"), (F.col("__k") + k + 1).alias("__k"))
        timed = timed.join(ranked, timed["ct"] == ranked["__ct"], "left").withColumn("k", F.coalesce("__k", F.lit(k)).cast("long")).drop("__ct", "__k")
        timed = materialize(timed)
        scores, told = S.feature_scores(timed, self.numeric, self.categorical, self.params, self.record, state, bounds)
        features = [*(["record"] if self.record else []), *self.numeric, *self.categorical]
        self._write(S.combined(scores, features), "scores", batch)
        # a cell's last entry is what it holds now; what it was left with before counts as an entry
        last = told.groupBy(*S.CELL).agg(F.max_by(F.struct("k", "decayed", "total"), F.struct("k", "new")).alias("s"))
        self._write(last.select(*S.CELL, "s.*"), "cells", batch)
        if self.numeric:
            logs = {c: F.when(F.col(c) != 0, F.log10(1 + F.col(c))) for c in self.numeric}
            ends = timed.agg(*[g(x).alias(f"{n}_{c}") for c, x in logs.items() for n, g in (("low", F.min), ("high", F.max))])
            old = {c: bounds.get(c, (None, None)) for c in self.numeric}
            wider = [
                F.struct(F.lit(c).alias("feature"), F.least(F.col(f"low_{c}"), F.lit(old[c][0]).cast("double")).alias("low"), F.greatest(F.col(f"high_{c}"), F.lit(old[c][1]).cast("double")).alias("high"))
                for c in self.numeric
            ]
            self._write(ends.select(F.explode(F.array(*wider)).alias("b")).select("b.*"), "bounds", batch)
        clock = timed.agg(F.max("ct").alias("ct"), F.max("k").alias("k")).select(F.coalesce("ct", before).alias("ct"), F.coalesce("k", F.lit(k)).cast("long").alias("k"))
        self._write(clock, "clock", batch)

    def run(self, stream: DataFrame, checkpoint: str | None = None, **trigger):
        """Starts the query over ``stream``; ``trigger`` as for writeStream, availableNow by default."""
        writer = stream.writeStream.foreachBatch(self.score_batch).option("checkpointLocation", checkpoint or f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/scores-*")


def new_folder(spark: SparkSession) -> str:
    """A folder for a stream's state that driver and executors share."""
    return f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, key, n) by tumbling window, or by windows that begin every ``slide``; rows later than ``late`` behind the newest are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(start, end, key, n): runs of a key's rows less than ``gap`` apart; the end is ``gap`` after the last row."""
    rows = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(stream: DataFrame, ts: str, key: str, seq: str, late: str, folder: str) -> DataFrame:
    """The first row by ``seq`` of each key, after everything available has been read; batches come in order.

    A batch, whatever rows of a key it holds, is reduced to its keys' first rows, and those whose key came before are left
    out. The keys met are a table in ``folder``, written by batch number; they and rows are dropped when they are ``late``
    behind the newest time of the batches before.
    """
    spark, kind = stream.sparkSession, stream.schema
    state = ", ".join(f"{c} {kind[c].dataType.simpleString()}" for c in dict.fromkeys((key, ts)))

    def keep(rows: DataFrame, batch: int) -> None:
        rows = materialize(rows)
        read = lambda name: spark.read.schema(state).parquet(f"{folder}/{name}-{batch - 1}") if batch > 0 else spark.createDataFrame([], state)
        newest = read("newest").agg(F.max(ts).alias("m"))
        due = lambda df: df.join(F.broadcast(newest), F.col("m").isNull() | (F.col(ts) >= F.col("m") - F.expr(f"interval {late}"))).drop("m")
        known = due(read("keys"))
        firsts = keep_first(due(rows), key, seq).join(known.select(F.col(key).alias("__known")), F.col(key).eqNullSafe(F.col("__known")), "left_anti")
        firsts.write.mode("overwrite").parquet(f"{folder}/firsts-{batch}")
        firsts = spark.read.schema(rows.schema).parquet(f"{folder}/firsts-{batch}")
        known.unionByName(firsts.select(*known.columns)).write.mode("overwrite").parquet(f"{folder}/keys-{batch}")
        read("newest").unionByName(rows.select(*known.columns)).agg(F.max(ts).alias(ts)).write.mode("overwrite").parquet(f"{folder}/newest-{batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind).parquet(f"{folder}/firsts-*")


def run_to_end(result: DataFrame, folder: str, mode: str) -> DataFrame:
    """All rows of a streaming result after everything available has been read; ``mode`` is complete or append."""
    out = f"{folder}/out"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch if mode == 'append' else 'all'}")

    writer = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{out}/*")
