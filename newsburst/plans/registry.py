"""Named queries with their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.plans.views import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over ``Tables``; ``sql`` is the same result in DuckDB's SQL."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Column types both engines print alike: doubles, text times, 0/1 flags, joined arrays."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return plain(QUERIES[name](Tables(spark, folder)))
