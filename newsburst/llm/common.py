"""Small helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsburst.session import file_system


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of ``column``, whatever the
    batch size of the session; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on, and a later stage's share of an
    executor must not be held by what an earlier one has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice that plans of finished steps are gone: Spark then removes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def shuffles_end_with_jobs(spark: SparkSession):
    """Spark removes the shuffle files of each query run inside as soon as that has ended, by a setting of Spark's own.
    ``free_shuffles`` alone leaves it to chance when the driver lets go of a plan."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drop_staged(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            system, folder = file_system(df.sparkSession, files[0].rsplit("/", 1)[0])
            system.delete(folder, True)
