"""Hot-event clustering: candidates, labels, event summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsburst.functions.scalars import age_micros, cluster_weight, hot_score, moment
from newsburst.operators import filters
from newsburst.operators.dbscan import NOISE, dbscan_labels
from newsburst.operators.shared import scope_labels
from newsburst.operators.visibility import exclusive_pairs, shared_pool
from newsburst.schemas import (
    DEFAULT_EPS,
    DEFAULT_HOURS,
    DEFAULT_MIN_SAMPLES,
    PRESETS,
    SAMPLE_SEPARATOR,
    SAMPLE_TITLES,
)

GLOBAL_SYSTEM = 0


class MissingConfig(ValueError):
    """A requested tenant has no configuration row."""


def resolve_parameters(
    systems: DataFrame, configs: DataFrame, hours=None, eps=None, min_samples=None
) -> DataFrame:
    """One row per tenant: an argument wins over the tenant's own setting.

    A cap of null or zero means no cap: every candidate is clustered.
    """
    cap = F.col("max_articles_limit")

    def given(value, column, cast):
        return (F.lit(value) if value is not None else F.col(column)).cast(cast)

    return systems.select("system_id").join(configs, "system_id").select(
        "system_id",
        given(hours, "default_hours", "int").alias("hours"),
        given(eps, "default_eps", "double").alias("eps"),
        given(min_samples, "default_min_samples", "int").alias("min_samples"),
        F.nullif(cap.cast("long"), F.lit(0)).alias("cap"),
    )


@dataclass(frozen=True)
class Scopes:
    """Tenant parameters with the two numbers a scan needs: the widest window, and the largest
    cap, null when some tenant has none."""

    params: DataFrame
    hours: int
    cap: int | None


def scopes(systems: DataFrame, configs: DataFrame, **options) -> Scopes:
    """Resolve parameters and raise when a tenant has no configuration; one small job."""
    params = resolve_parameters(systems, configs, **options)
    known = params.withColumn("known", F.lit(True))
    asked = systems.select("system_id").join(known, "system_id", "left")
    missing = F.when(F.col("known").isNull(), F.col("system_id"))
    lost, low, high, hours, cap, capped, rows = asked.agg(
        F.count(missing), F.min(missing), F.max(missing), F.max("hours"), F.max("cap"), F.count("cap"), F.count("*")
    ).first()
    if lost:
        raise MissingConfig(f"no configuration for {lost} tenants, between {low} and {high}")
    return Scopes(params, hours or 0, cap if rows and capped == rows else None)


def _tenant_pairs(narrow: DataFrame, pool: DataFrame, links: DataFrame, params: DataFrame) -> DataFrame:
    """(tenant, article) pairs with the tenant's parameters; ``share`` is null for the pool, whose rows
    the tenants have in common, and the tenant for its own and linked rows."""
    ids = params.agg(F.sort_array(F.collect_set("system_id")).alias("ids"))
    shared = pool.select(F.explode(ids.scalar()).alias("system_id"), "id", "create_time")
    shared = shared.withColumn("share", F.lit(None).cast("long"))
    own = exclusive_pairs(narrow, links, params).withColumn("share", F.col("system_id"))
    return own.unionByName(shared).join(params, "system_id")


def _newest_minutes(rows: DataFrame, cap: int) -> DataFrame:
    """The rows of the newest minutes that hold ``cap`` rows together, or all: counts decide, no
    rows are sorted."""
    minute = F.date_trunc("minute", "create_time")
    counts = rows.groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))
    newer = Window.orderBy(F.col("minute").desc()).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).filter(F.col("newer") < cap)
    return rows.filter(F.col("create_time") >= needed.agg(F.min("minute")).scalar())


def tenant_candidates(articles: DataFrame, links: DataFrame, tenants: Scopes, as_of) -> DataFrame:
    """(system_id, id, create_time, eps, min_samples, cap) of all given tenants.

    The widest window of any tenant goes to the scan; each tenant's own window follows on
    the narrow pairs. Where all tenants have caps, only the newest rows of the shared pool up to
    the largest cap can be among any tenant's newest rows; older minutes are left out before the
    pool is repeated per tenant, and the result is the same.
    """
    narrow = filters.within_hours(filters.not_deleted(filters.embedded(articles)), as_of, tenants.hours)
    narrow = narrow.select("id", "system_id", "is_shared", "create_time")
    pool = shared_pool(narrow).select("id", "create_time")
    if tenants.cap is not None:
        pool = _newest_minutes(pool, tenants.cap)
    own_window = moment(as_of, articles) - F.make_dt_interval(F.lit(0), F.col("hours"))
    pairs = _tenant_pairs(narrow, pool, links, tenants.params).filter(F.col("create_time") >= own_window)
    return pairs.select("system_id", "id", "create_time", "eps", "min_samples", "cap", "share")


def backfill_candidates(
    articles: DataFrame, links: DataFrame, tenants: Scopes, first_tick, ticks: int, step_minutes: int
) -> DataFrame:
    """Candidates of every tenant at every tick of a regular grid, keyed (system_id, tick).

    A pair is repeated for the ticks whose window holds it, found by arithmetic on its time
    - one scan, however many ticks there are. A tick does not see newer articles.
    """
    kind = articles.schema["create_time"].dataType
    start = moment(first_tick, articles)
    last = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit((ticks - 1) * step_minutes))
    narrow = filters.within_hours(filters.not_deleted(filters.embedded(articles)), first_tick, tenants.hours)
    narrow = narrow.filter(F.col("create_time") <= last)
    narrow = narrow.select("id", "system_id", "is_shared", "create_time")
    pool = shared_pool(narrow).select("id", "create_time")
    step = step_minutes * 60_000_000
    since = age_micros(start, kind) - age_micros(F.col("create_time"), kind)
    until = since + F.col("hours").cast("long") * F.lit(3_600_000_000)
    from_tick = F.greatest(F.lit(0).cast("long"), F.ceil(since / F.lit(step)))
    to_tick = F.least(F.lit(ticks - 1).cast("long"), F.floor(until / F.lit(step)))
    return (
        _tenant_pairs(narrow, pool, links, tenants.params)
        .withColumns({"_from": from_tick, "_to": to_tick})
        .filter(F.col("_from") <= F.col("_to"))
        .withColumn("_n", F.explode(F.sequence("_from", "_to")))
        .withColumn("tick", start + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("_n") * step_minutes).cast("int")))
        .select("system_id", "tick", "id", "create_time", "eps", "min_samples", "cap", "share")
    )


def global_candidates(
    articles: DataFrame,
    as_of,
    hours: int = DEFAULT_HOURS,
    eps: float = DEFAULT_EPS,
    min_samples: int = DEFAULT_MIN_SAMPLES,
    cap: int | None = None,
) -> DataFrame:
    """Candidates without tenants, under one pseudo tenant. Deleted rows are not left out.

    All candidates count unless a ``cap`` on the newest is given (80,000 is usual).
    """
    recent = filters.within_hours(filters.embedded(articles), as_of, hours)
    return recent.select(
        F.lit(GLOBAL_SYSTEM).cast("long").alias("system_id"),
        "id",
        "create_time",
        F.lit(eps).cast("double").alias("eps"),
        F.lit(min_samples).cast("int").alias("min_samples"),
        F.lit(cap).cast("long").alias("cap"),
    )


def summarize(labels: DataFrame, articles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cluster with title, size, weight, score, sample titles and member ids.

    Member ids are part of the result. Titles are cut to the first few per cluster before they
    are gathered.
    """
    time_type = labels.schema["create_time"].dataType
    # Wide columns are joined to the clustered rows only, noise is gone by then.
    clustered = labels.filter(F.col("cluster_id") != NOISE).join(
        articles.select("id", "title", "weight"), "id"
    )
    group = [*keys, "cluster_id"]
    order = F.struct(age_micros(F.col("create_time"), time_type).alias("age"), "id")
    sizes = clustered.groupBy(*group).agg(
        F.count("*").alias("article_count"),
        F.sum(cluster_weight(F.col("weight"))).cast("decimal(16,4)").alias("total_weight"),
        F.transform(
            F.array_sort(F.collect_list(order)), lambda s: s["id"]
        ).alias("article_ids"),
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*filters.newest_first()))
    titles = (
        clustered.select(*group, "id", "create_time", "title")
        .withColumn("rn", rank)
        .filter(F.col("rn") <= SAMPLE_TITLES)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "title"))).alias("firsts"))
        .select(
            *group,
            F.col("firsts")[0]["title"].alias("title"),
            F.array_join(
                F.transform("firsts", lambda s: s["title"]), SAMPLE_SEPARATOR
            ).alias("sample_titles"),
        )
    )
    return sizes.join(titles, group).select(
        *keys,
        "cluster_id",
        "title",
        "article_count",
        "total_weight",
        hot_score(F.col("total_weight"), F.col("article_count")).cast("decimal(18,6)").alias("hot_score"),
        "sample_titles",
        "article_ids",
    )


def tenant_labels(
    articles, links, systems, configs, as_of, hours=None, eps=None, min_samples=None, **grid
) -> DataFrame:
    tenants = scopes(systems, configs, hours=hours, eps=eps, min_samples=min_samples)
    candidates = tenant_candidates(articles, links, tenants, as_of)
    recent = filters.within_hours(filters.not_deleted(filters.embedded(articles)), as_of, tenants.hours)
    return scope_labels(candidates, recent.select("id", "embedding"), ["system_id"], **grid)


def global_labels(articles, as_of, hours=DEFAULT_HOURS, eps=DEFAULT_EPS,
                  min_samples=DEFAULT_MIN_SAMPLES, cap=None, **grid) -> DataFrame:
    candidates = global_candidates(articles, as_of, hours, eps, min_samples, cap)
    recent = filters.within_hours(filters.embedded(articles), as_of, hours)
    return dbscan_labels(candidates, recent.select("id", "embedding"), ["system_id"], **grid)


def cluster_events(
    articles, links, systems, configs, as_of, hours=None, eps=None, min_samples=None, **grid
) -> DataFrame:
    """Events of every tenant in ``systems``, clustered in one job; with a ``store`` only what is new since
    its last run is compared."""
    tenants = scopes(systems, configs, hours=hours, eps=eps, min_samples=min_samples)
    candidates = tenant_candidates(articles, links, tenants, as_of)
    # One windowed table gives vectors, titles and weights.
    recent = filters.within_hours(filters.not_deleted(filters.embedded(articles)), as_of, tenants.hours)
    labels = scope_labels(candidates, recent.select("id", "embedding"), ["system_id"], **grid)
    return summarize(labels, recent, ["system_id"])


def cluster_events_global(articles, as_of, hours=DEFAULT_HOURS, eps=DEFAULT_EPS,
                          min_samples=DEFAULT_MIN_SAMPLES, cap=None, **grid) -> DataFrame:
    labels = global_labels(articles, as_of, hours, eps, min_samples, cap, **grid)
    return summarize(labels, filters.within_hours(filters.embedded(articles), as_of, hours), ["system_id"])


def backfill_events(
    articles, links, systems, configs, first_tick, ticks: int, step_minutes: int, **grid
) -> DataFrame:
    """Events as they would have been at each tick; every (tenant, tick) is its own scope of
    one clustering job. Two articles are compared once, however many ticks see both."""
    tenants = scopes(systems, configs)
    candidates = backfill_candidates(articles, links, tenants, first_tick, ticks, step_minutes)
    recent = filters.within_hours(filters.not_deleted(filters.embedded(articles)), first_tick, tenants.hours)
    labels = scope_labels(candidates, recent.select("id", "embedding"), ["system_id", "tick"], **grid)
    return summarize(labels, recent, ["system_id", "tick"])


def preset_candidates(articles, as_of, presets: dict[str, tuple], cap=None) -> tuple[DataFrame, DataFrame]:
    """(candidates keyed by preset, rows of the widest window); a preset is (eps, min_samples, hours)."""
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("preset"),
                F.lit(eps).cast("double").alias("eps"),
                F.lit(min_samples).cast("int").alias("min_samples"),
                F.lit(hours).cast("int").alias("hours"),
            )
            for name, (eps, min_samples, hours) in presets.items()
        ]
    )
    recent = filters.within_hours(filters.embedded(articles), as_of, max(hours for *_, hours in presets.values()))
    since = moment(as_of, articles) - F.make_dt_interval(F.lit(0), F.col("o.hours"))
    seen = recent.select("id", "create_time", F.explode(options).alias("o")).filter(F.col("create_time") >= since)
    candidates = seen.select(
        "o.preset", "id", "create_time", "o.eps", "o.min_samples", F.lit(cap).cast("long").alias("cap"),
        F.lit(None).cast("long").alias("share"),
    )
    return candidates, recent


def cluster_presets(articles, as_of, hours=None, presets=PRESETS, cap=None, **grid) -> DataFrame:
    """Global events under each named preset: (eps, min_samples), with ``hours`` for all, or (eps,
    min_samples, hours). Two articles are compared once, at the distances of all presets that see both."""
    full = {name: (*given, hours)[:3] for name, given in presets.items()}
    candidates, recent = preset_candidates(articles, as_of, full, cap)
    labels = scope_labels(candidates, recent.select("id", "embedding"), ["preset"], **grid)
    return summarize(labels, recent, ["preset"])


def rank_events(events: DataFrame, keys: list[str], limit=None) -> DataFrame:
    """Add ``rank_no`` by score (ties by cluster number) and keep the first ``limit``.

    ``limit`` is a number, or the name of a column that holds each tenant's own limit.
    """
    window = Window.partitionBy(*keys).orderBy(F.col("hot_score").desc(), F.col("cluster_id").asc())
    ranked = events.withColumn("rank_no", F.row_number().over(window))
    if limit is None:
        return ranked
    bound = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return ranked.filter(F.col("rank_no") <= bound)
