"""Snapshots of ranked events and the read queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsburst.functions.scalars import link_weight
from newsburst.operators import filters
from newsburst.operators.cluster import cluster_events, rank_events
from newsburst.schemas import DEFAULT_HOURS, DEFAULT_MODEL, DEFAULT_SNAPSHOT_LIMIT
from newsburst.session import stage

EVENT_KEYS = ["snapshot_time", "rank_no", "system_id"]
SNAPSHOT_COLUMNS = [
    "snapshot_time",
    "rank_no",
    "system_id",
    "cluster_id",
    "title",
    "article_count",
    "total_weight",
    "hot_score",
    "sample_titles",
    "hours_window",
    "model_name",
]


def snapshot_rows(ranked: DataFrame, snapshot_time, model_name: str = DEFAULT_MODEL) -> DataFrame:
    """Snapshot rows of ranked events; ``ranked`` carries the window actually used in ``hours``,
    ``model_name`` says what made the vectors."""
    return ranked.select(
        snapshot_time.alias("snapshot_time"),
        "rank_no",
        "system_id",
        "cluster_id",
        "title",
        "article_count",
        "total_weight",
        "hot_score",
        "sample_titles",
        F.col("hours").alias("hours_window"),
        F.lit(model_name).alias("model_name"),
    )


def unnest_articles(ranked: DataFrame) -> DataFrame:
    """One row per event and member; ``position`` is the member's newest-first place."""
    return ranked.select(
        *[c for c in ranked.columns if c != "article_ids"],
        F.posexplode("article_ids").alias("position", "article_id"),
    )


def event_article_rows(ranked: DataFrame, articles: DataFrame, snapshot_time) -> DataFrame:
    members = unnest_articles(ranked.select("system_id", "rank_no", "cluster_id", "article_ids"))
    weights = articles.select(F.col("id").alias("article_id"), "weight")
    return members.join(weights, "article_id", "left").select(
        snapshot_time.alias("snapshot_time"),
        "rank_no",
        "system_id",
        "cluster_id",
        "article_id",
        link_weight(F.col("weight")).alias("article_weight"),
    )


def with_limits(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Add each tenant's ``snapshot_limit`` and window ``hours``."""
    limits = configs.select(
        "system_id",
        F.coalesce("snapshot_limit", F.lit(DEFAULT_SNAPSHOT_LIMIT)).alias("snapshot_limit"),
        F.col("default_hours").alias("hours"),
    )
    return events.join(limits, "system_id")


def build_snapshot(
    articles, links, systems, configs, as_of, snapshot_time, model_name: str = DEFAULT_MODEL,
    due: DataFrame | None = None, **grid,
) -> tuple[DataFrame, DataFrame]:
    """Cluster once, keep each tenant's top events, and derive both snapshot tables; of the ``due``
    tenants where some are given."""
    events = cluster_events(articles, links, systems, configs, as_of, **grid)
    if due is not None:
        events = events.join(due.select("system_id"), "system_id", "left_semi")
    ranked = stage(rank_events(with_limits(events, configs), ["system_id"], "snapshot_limit"), "ranked")
    # Members lie in the widest window; the weights of older articles are not read.
    hours = grid.get("hours") or configs.agg(F.max("default_hours")).first()[0] or 0
    return (
        snapshot_rows(ranked, snapshot_time, model_name),
        event_article_rows(ranked, filters.within_hours(articles, as_of, hours), snapshot_time),
    )


def replace_tenants(old: DataFrame, new: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Rows of refreshed tenants are replaced - by nothing when they have no events -
    and rows of all other tenants stay."""
    kept = old.join(refreshed.select("system_id"), "system_id", "left_anti")
    return kept.select(new.columns).unionByName(new)


def keep_history(snapshot: DataFrame, n: int) -> DataFrame:
    """The last ``n`` snapshots of each tenant. Times are ranked, not the wide rows."""
    times = snapshot.select("system_id", "snapshot_time").distinct()
    newest = Window.partitionBy("system_id").orderBy(F.col("snapshot_time").desc())
    kept = times.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")
    return snapshot.join(kept, ["system_id", "snapshot_time"], "left_semi")


def latest_time(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("system_id").agg(F.max("snapshot_time").alias("snapshot_time"))


def latest_per_tenant(snapshot: DataFrame, limit: int | None = None) -> DataFrame:
    """Each tenant's newest snapshot, its first ``limit`` ranks when a limit is given."""
    latest = snapshot.join(latest_time(snapshot), ["system_id", "snapshot_time"], "left_semi")
    return latest.filter(F.col("rank_no") <= limit) if limit and limit > 0 else latest


def latest_global(snapshot: DataFrame, rank_no: int | None = None, limit: int | None = None) -> DataFrame:
    """The snapshot rows of the newest time over all tenants."""
    newest = snapshot.agg(F.max("snapshot_time")).scalar()
    rows = snapshot.filter(F.col("snapshot_time") == newest)
    if rank_no is not None:
        rows = rows.filter(F.col("rank_no") == rank_no)
    return filters.truncate(rows.orderBy("rank_no", "system_id"), limit)


def at_time(snapshot: DataFrame, snapshot_time) -> DataFrame:
    return snapshot.filter(F.col("snapshot_time") == snapshot_time).orderBy("rank_no", "system_id")


def display(events: DataFrame) -> DataFrame:
    return events.select(
        "system_id",
        F.col("rank_no").alias("position"),
        F.col("title").alias("hot_event"),
        F.col("article_count").alias("reports"),
        "total_weight",
        F.round("hot_score", 2).alias("heat"),
        F.col("sample_titles").alias("related_titles"),
    )


def event_members(
    snapshot: DataFrame, event_articles: DataFrame, articles: DataFrame, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Snapshot rows joined to their links and articles; ``system_id`` is the event's tenant,
    ``owner_id`` the article's own. ``carried``: further columns of the snapshot to keep."""
    named = articles.withColumnsRenamed({"id": "article_id", "system_id": "owner_id"})
    return (
        snapshot.select(*EVENT_KEYS, *carried)
        .join(event_articles, EVENT_KEYS)
        .join(named, "article_id")
        .withColumnRenamed("article_id", "id")
    )


def snapshot_event_articles(
    snapshot, event_articles, articles, system_id: int, rank_no: int, limit: int | None = 50
) -> DataFrame:
    """Articles of one ranked event of a tenant's newest snapshot, heaviest first."""
    wanted = latest_per_tenant(snapshot.filter(F.col("system_id") == system_id))
    wanted = wanted.filter(F.col("rank_no") == rank_no)
    members = event_members(wanted, event_articles, filters.not_deleted(articles))
    return filters.heaviest_first(members, limit)


def live_event_articles(
    events: DataFrame, articles: DataFrame, system_id: int, cluster_id: int, limit: int | None = 50
):
    """Articles of one live event of one tenant, heaviest first."""
    wanted = (F.col("system_id") == system_id) & (F.col("cluster_id") == cluster_id)
    ids = events.filter(wanted).select(
        F.explode("article_ids").alias("id")
    )
    return filters.heaviest_first(articles.join(ids, "id", "left_semi"), limit)


def live_drill_down(
    articles, links, systems, configs, as_of, system_id: int, cluster_id: int,
    hours: int = DEFAULT_HOURS, limit: int | None = 50, **options
) -> DataFrame:
    """Cluster one tenant's articles now and list those of one event. The window has its own
    default; distance and size come from the tenant's settings."""
    one = systems.filter(F.col("system_id") == system_id)
    events = cluster_events(articles, links, one, configs, as_of, hours=hours, **options)
    return live_event_articles(events, articles, system_id, cluster_id, limit)


def overview(systems: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Events of all active tenants with the tenant's names."""
    names = systems.filter("is_active").select("system_id", "system_code", "system_name")
    return (
        names.join(snapshot, "system_id")
        .select(
            "system_id",
            "system_code",
            "system_name",
            "snapshot_time",
            "rank_no",
            "cluster_id",
            "title",
            "article_count",
            "total_weight",
            "hot_score",
            "sample_titles",
        )
        .orderBy("system_code", F.col("snapshot_time").desc(), "rank_no")
    )
