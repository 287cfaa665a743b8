"""Session settings and the shared folder where jobs cut their lineage."""

import os
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Vector sums keep one buffer per (series, window); let a task hold more of
    # them before it falls back to sorting its input.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # One BLAS thread per Python worker: Spark supplies the parallelism.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def build_session(app: str = "slowtide", master: str | None = None, **overrides) -> SparkSession:
    """Start (or join) a session with the settings the jobs are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    ``spark.checkpoint.dir``, or else the session's warehouse if all of them can read and
    write it: one in a store, or any if the executors are this machine's own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return checked_shared(warehouse, spark.sparkContext.master)


def checked_shared(folder: str, master: str) -> str:
    """The folder; an error if it lies on one machine's disk and executors run on others."""
    local = urlsplit(folder).scheme in ("", "file")
    if local and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{folder} is a folder of the driver's machine: set spark.checkpoint.dir to one that all executors share")
    return folder


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "slowtide", spark.sparkContext.applicationId)


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in this application's part of the shared folder."""
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex}")


def drop_intermediate(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are stored elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Store a result in the shared folder and continue from the stored table.

    The table is columnar, so its readers still prune columns, and it outlives
    the executors that computed it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
