"""Counts and per-tenant article statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsburst.operators import filters
from newsburst.operators.visibility import exclusive_pairs, shared_pool, visible_to

COUNTS = ["total_articles", "embedded_articles", "shared_articles", "active_articles"]


def _article_flags(articles: DataFrame) -> list:
    """Conditional counts per article row; article ids are unique, so a sum is a distinct count."""
    return [
        F.count("id").alias("total_articles"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedded_articles"),
        F.count_if(F.col("is_shared")).alias("shared_articles"),
        F.count_if(F.col("is_deleted") == F.lit(False)).alias("active_articles"),
        F.max("create_time").alias("latest_article_time"),
    ]


def owned_stats(systems: DataFrame, articles: DataFrame) -> DataFrame:
    """Per active tenant: counts over the articles it owns; tenants without any stay, with zeros.

    Aggregates the articles first and joins the few result rows to the tenants, so the hot
    tenant's rows are combined before any shuffle.
    """
    slim = articles.select(
        "id", "system_id", F.when(F.col("embedding").isNotNull(), 1).alias("embedding"),
        "is_shared", "is_deleted", "create_time",
    )
    per_tenant = slim.groupBy("system_id").agg(*_article_flags(slim))
    return _with_tenants(systems, per_tenant)


def _with_tenants(systems: DataFrame, per_tenant: DataFrame) -> DataFrame:
    names = systems.filter("is_active").select("system_id", "system_code", "system_name")
    return names.join(per_tenant, "system_id", "left").select(
        "system_id",
        "system_code",
        "system_name",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS],
        "latest_article_time",
    )


def visible_stats(systems: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """The same counts over every article a tenant can see.

    The shared pool is counted once and added to each tenant's own and linked articles,
    instead of being repeated per tenant.
    """
    slim = articles.select(
        "id", "system_id", "is_shared",
        F.when(F.col("embedding").isNotNull(), 1).alias("embedding"),
        F.col("is_shared").alias("_shared"), "is_deleted", "create_time",
    )
    tenants = systems.filter("is_active")
    private = (
        exclusive_pairs(slim, links, tenants)
        .withColumnRenamed("_shared", "is_shared")
        .groupBy("system_id")
        .agg(*_article_flags(slim))
    )
    pool = shared_pool(slim).agg(*_article_flags(slim))
    pool = pool.select(F.struct(*pool.columns).alias("pool")).scalar()
    mine = _with_tenants(systems, private).withColumn("pool", pool)
    return mine.select(
        "system_id",
        "system_code",
        "system_name",
        *[(F.col(c) + F.col(f"pool.{c}")).alias(c) for c in COUNTS],
        F.greatest("latest_article_time", "pool.latest_article_time").alias("latest_article_time"),
    )


def pending_count(articles: DataFrame, as_of) -> DataFrame:
    return filters.pending_embedding(articles, as_of).agg(F.count("*").alias("pending"))


def monitoring_counts(articles: DataFrame, snapshot: DataFrame, as_of) -> DataFrame:
    pending = filters.pending_embedding(articles, as_of).agg(F.count("*").alias("n"))
    return pending.select(F.lit("pending_embeddings").alias("metric"), "n").unionByName(
        snapshot.agg(F.count("*").alias("n")).select(F.lit("snapshot_rows").alias("metric"), "n")
    )


def unowned_counts(**tables: DataFrame) -> DataFrame:
    """Rows per table that a move to the default tenant would touch."""
    parts = [
        df.filter(F.col("system_id").isNull()).agg(F.count("*").alias("migrated")).select(
            F.lit(name).alias("table_name"), "migrated"
        )
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def listing(articles, links=None, system_id=None, **article_filters) -> DataFrame:
    """Articles of one tenant, or of all, that pass the optional filters; never deleted ones."""
    rows = filters.article_filters(filters.not_deleted(articles), **article_filters)
    if system_id is not None:
        rows = visible_to(rows, links, system_id)
    return rows
