"""Row filters, limits and paging. Each is a plain predicate so that it reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsburst.functions.scalars import hours_interval, is_pending, moment
from newsburst.schemas import EMBED_BATCH_ROWS, EMBED_WINDOW_DAYS


def not_deleted(df: DataFrame) -> DataFrame:
    """``is_deleted = false``: a null flag is left out."""
    return df.filter(F.col("is_deleted") == F.lit(False))


def embedded(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull())


def within_hours(df: DataFrame, as_of, hours) -> DataFrame:
    """Rows at or after ``as_of - hours``; the lower bound is inclusive, there is no upper one.

    A table partitioned by ``create_date`` is pruned to the days of the window.
    """
    since = moment(as_of, df) - hours_interval(hours)
    if "create_date" in df.columns:
        df = df.filter(F.col("create_date") >= F.to_date(since))
    return df.filter(F.col("create_time") >= since)


def pending_embedding(df: DataFrame, as_of, days: int = EMBED_WINDOW_DAYS) -> DataFrame:
    """Articles still to be encoded; the bound at ``as_of - days`` is exclusive."""
    after = moment(as_of, df) - F.make_dt_interval(F.lit(days))
    return df.filter((F.col("create_time") > after) & is_pending(F.col("embedding")))


def active(systems: DataFrame) -> DataFrame:
    return systems.filter(F.col("is_active"))


def article_filters(
    df: DataFrame,
    source: str | None = None,
    min_weight=None,
    max_weight=None,
    keyword: str | None = None,
) -> DataFrame:
    """Optional filters of the article listing; a filter that is not given adds nothing."""
    if source is not None:
        df = df.filter(F.col("source") == source)
    if min_weight is not None:
        df = df.filter(F.col("weight") >= F.lit(min_weight).cast("decimal(16,4)"))
    if max_weight is not None:
        df = df.filter(F.col("weight") <= F.lit(max_weight).cast("decimal(16,4)"))
    if keyword is not None:
        df = df.filter(F.contains(F.col("title"), F.lit(keyword)))
    return df


def newest_first() -> list[Column]:
    return [F.col("create_time").desc(), F.col("id").asc()]


def page(df: DataFrame, number: int = 0, size: int = 20) -> DataFrame:
    return df.orderBy(*newest_first()).offset(number * size).limit(size)


def embed_batch(df: DataFrame, rows: int = EMBED_BATCH_ROWS) -> DataFrame:
    """The batch the encoder takes per run."""
    return df.orderBy(*newest_first()).limit(rows)


def truncate(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit and limit > 0 else df


def heaviest_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.col("weight").desc(), F.col("create_time").desc(), F.col("id").asc())
    return truncate(ordered, limit)
