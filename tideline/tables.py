"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The one folder in the shared one that holds all this application writes; it goes when the driver ends.

    It bears the application's id, so what a killed driver left can be told from what runs.
    """
    name = spark.sparkContext.applicationId
    if name not in _runs:
        _runs[name] = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _runs[name])
    return _runs[name]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the run's folder and read it again: later jobs read files that outlive any executor."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared store."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone already
        pass
