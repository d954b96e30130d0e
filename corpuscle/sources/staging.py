"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, in a folder that goes when the application ends.

    Where that is unset the folder is a local one, which only works, and is only allowed, where all runs in this process.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {spark.sparkContext.master} share no local folder")
            shared = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        _roots[app] = f"{shared.rstrip('/')}/core-{app}-{uuid.uuid4().hex[:8]}"
        target = spark._jvm.org.apache.hadoop.fs.Path(_roots[app])
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(target)
        system.deleteOnExit(target)
    return f"{_roots[app]}/{uuid.uuid4().hex}-{label}"


#: The setting that has a query's shuffle files removed as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Writes df as Parquet and reads it back: what follows neither computes it again nor drags its lineage along.

    free: the shuffles of this write are removed as it ends; otherwise they go when the driver collects its garbage.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, None)
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to four tasks a core, where it comes in fewer files: a small file is few tasks, however long each row takes."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n)


#: The setting for the bytes of a batch between Spark and Python, and its value here unless the session gives a smaller one.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Both sides hold a batch in memory; by default one may take 10,000 texts, and what Python makes of them is many times as large."""
    try:
        given = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)))
    except Exception:  # a version of Spark without the setting
        return
    if given <= 0 or given > int(_BATCH_BYTES):
        spark.conf.set(_BATCH, _BATCH_BYTES)
