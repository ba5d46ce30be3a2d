"""Session helpers: the shared work folder and staged (lineage-cutting) tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app: str = "newsburst", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    What the cluster's own configuration sets already stays; ``conf`` wins over both.
    """
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    given = SparkConf()
    settings = {k: v for k, v in settings.items() if not given.contains(k)} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own; on a cluster a
    machine-local folder would not be visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="newsburst-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/newsburst/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage for iterative work and keeps a result that several plans read from
    being computed again; the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path itself, for listing and removing folders, which
    Spark's own API does not offer."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


# Bytes of table files for a task of row-wise work, about.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that sits in fewer files than there are cores before heavy row-wise
    work, into as many tasks as there are cores, and more where the files are large: a task's share must not grow
    with the table. Large tables have many files and are left alone: no shuffle. The names asked for are
    those that the driver's own file index holds to plan the scan."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return df
    size = sum(system.getFileStatus(path).getLen() for system, path in (file_system(df.sparkSession, f) for f in files))
    return df.repartition(max(cores, math.ceil(size / SPREAD_BYTES)))


def single_threaded_blas(spark: SparkSession) -> None:
    """One BLAS thread per Python worker: the parallelism is the task count."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
