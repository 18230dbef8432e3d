"""Codes of categorical values over a stream: numbered by first occurrence, the same in all batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import dense_numbers
from ..tables import materialize


class StreamEncoder:
    """Encodes micro-batches in ``foreachBatch``: value columns become codes from 1, null becomes 0.

    State is one table a column in ``folder``, which driver and executors must share: (value, code) of all values
    so far, written by batch number, so a batch that is tried again gives the same codes. ``step`` columns become
    steps of ``width`` since the first record's value, which is kept as well. A value is joined, never looked up
    on the driver: the tables may be as large as the number of different values.
    """

    def __init__(self, spark: SparkSession, columns: list[str], folder: str, step: str | None = None, width: int = 1):
        self.spark, self.columns, self.folder, self.step, self.width = spark, columns, folder.rstrip("/"), step, width

    def _known(self, column: str, batch: int, kind: str) -> DataFrame:
        schema = f"value {kind}, code long"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{column}-{batch}") if batch >= 0 else self.spark.createDataFrame([], schema)

    def encode_batch(self, rows: DataFrame, batch: int) -> None:
        """Encodes ``rows`` (seq, columns) and leaves codes-<batch> and the tables of its columns."""
        rows = materialize(rows)
        for c in self.columns:
            known = self._known(c, batch - 1, rows.schema[c].dataType.simpleString())
            n = known.agg(F.coalesce(F.max("code"), F.lit(0)).alias("n")).first()["n"]
            firsts = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.min("seq").alias("first")).join(known, "value", "left_anti")
            new = dense_numbers(firsts, ["first", "value"], "code").select("value", (F.col("code") + n + 1).alias("code"))
            known.unionByName(new).write.mode("overwrite").parquet(f"{self.folder}/{c}-{batch}")
            table = self.spark.read.parquet(f"{self.folder}/{c}-{batch}")
            rows = rows.join(table, F.col(c) == F.col("value"), "left").withColumn(c, F.coalesce("code", F.lit(0)).cast("long")).drop("value", "code")
        if self.step:
            rows = rows.withColumn("step", F.floor((F.col(self.step) - F.lit(self._first(rows, batch))) / F.lit(self.width)).cast("long"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/codes-{batch}")

    def _first(self, rows: DataFrame, batch: int) -> int:
        """The step column of the first record of the stream."""
        path = f"{self.folder}/first-{batch}"
        if batch > 0:
            found = self.spark.read.parquet(f"{self.folder}/first-{batch - 1}")
        else:
            found = rows.groupBy().agg(F.min_by(self.step, "seq").alias("first"))
        found.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).first()["first"]

    def run(self, stream: DataFrame, checkpoint: str | None = None):
        """Starts the query over ``stream``, all that is available."""
        writer = stream.writeStream.foreachBatch(self.encode_batch).option("checkpointLocation", checkpoint or f"{self.folder}/checkpoint")
        return writer.trigger(availableNow=True).start()

    def codes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/codes-*")
