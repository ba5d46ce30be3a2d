"""Registered queries: clustering, scoring, snapshots and the reads over them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from newsburst.functions.scalars import age_micros, cluster_weight, moment
from newsburst.operators import cluster as C
from newsburst.operators import events as E
from newsburst.operators import filters
from newsburst.operators.dbscan import neighbour_counts, newest_per_key, recency_numbers
from newsburst.operators.events import unnest_articles
from newsburst.operators.stats import monitoring_counts, unowned_counts
from newsburst.operators.components import connected_components
from newsburst.plans.oracle import (
    EVENTS,
    LABELS,
    TIME,
    global_sql,
    stored_sql,
    tenant_sql,
    ticks_sql,
    with_views,
)
from newsburst.plans.registry import ORACLES, query
from newsburst.plans.relational import ARTICLE, CREATED, PENDING, article
from newsburst.operators.shared import shared_labels
from newsburst.schemas import PRESETS, WINDOW_PRESETS
from newsburst.session import scratch_path, stage
from newsburst.sources import ingest

GLOBAL = {"hours": 720, "eps": 0.6, "min_samples": 3}
SEEN = TIME.format("snapshot_time")


def tenant_events(t, systems=None, **options):
    return C.cluster_events(
        t.articles, t.links, systems if systems is not None else t.active_systems, t.configs, t.as_of, **options
    )


def tenant_labels(t, **options):
    return C.tenant_labels(t.articles, t.links, t.active_systems, t.configs, t.as_of, **options)


def global_events(t, **options):
    return C.cluster_events_global(t.articles, t.as_of, **{**GLOBAL, **options})


def global_labels(t, **options):
    return C.global_labels(t.articles, t.as_of, **{**GLOBAL, **options})


def candidates(t):
    return C.tenant_candidates(t.articles, t.links, C.scopes(t.active_systems, t.configs), t.as_of)


EVENT = "cluster_id, title, article_count, total_weight, hot_score, sample_titles, article_ids"
EVENT_COLUMNS = EVENT.split(", ")

# -- neighbourhoods, components, labels ------------------------------------------------------


@query("j12_neighbour_counts", global_sql(
    "select pts.id, count(*) neighbours from ed join pts on pts.rn = ed.i group by pts.id"))
def j12(t):
    """Neighbours within the distance per article, itself included, over the block grid."""
    found = C.global_candidates(t.articles, t.as_of, **GLOBAL)
    recent = filters.within_hours(filters.embedded(t.articles), t.as_of, GLOBAL["hours"])
    counts = neighbour_counts(found, recent.select("id", "embedding"), ["system_id"], block_rows=64)
    return counts.select("id", "neighbours")


@query("c0_parameters", with_views("""
select system_id, default_hours as "hours", cast(0.5 as double) eps, default_min_samples min_samples,
       cast(nullif(max_articles_limit, 0) as bigint) cap
from active join configs using (system_id)
"""))
def c0(t):
    return C.resolve_parameters(t.active_systems, t.configs, eps=0.5)


@query("c1_candidates", tenant_sql(f"select k system_id, id, {CREATED} create_time from pts"))
def c1(t):
    rows = newest_per_key(stage(candidates(t), "candidates"), ["system_id"])
    return rows.select("system_id", "id", "create_time")


@query("c2_core_points", global_sql("select pts.id, (co.i is not null)::int is_core from pts left join co on co.i = pts.rn"))
def c2(t):
    return global_labels(t).select("id", "is_core")


@query("c3_components", """
with recursive pairs as (select o_orderkey a, o_custkey + 1000000000 b from orders),
sides as materialized (select a, b from pairs union select b, a from pairs),
walk(n, l) as (select a, a from sides union select b, l from walk join sides on a = n where l < b)
select n id, min(l) root from walk group by n
""")
def c3(t):
    """Connected components of the graph of orders and their customers."""
    return connected_components(stage(_customer_graph(t), "edges"), ["system_id"]).select("id", "root")


def _customer_graph(t):
    orders = t.spark.read.parquet(f"{t.folder}/orders.parquet")
    return orders.select(
        F.lit(0).cast("long").alias("system_id"),
        F.col("o_orderkey").cast("long").alias("a"),
        (F.col("o_custkey").cast("long") + 1000000000).alias("b"),
    )


@query("c4_numbered_labels", tenant_sql("select k system_id, id, cluster_id, is_core::int is_core from labels_"))
def c4(t):
    return tenant_labels(t).select("system_id", "id", "cluster_id", "is_core")


@query("c5_cluster_summary", global_sql(f"select {EVENT} from ev"))
def c5(t):
    return global_events(t).select(*EVENT_COLUMNS)


@query("c6_tenant_clusters", tenant_sql(f"select k system_id, {EVENT} from ev"))
def c6(t):
    return tenant_events(t).select("system_id", *EVENT_COLUMNS)


@query("c7_global_clusters", global_sql(f"select {EVENT} from ev", eps=0.65, ms=2))
def c7(t):
    return global_events(t, eps=0.65, min_samples=2).select(*EVENT_COLUMNS)


@query("c8_point_labels", global_sql(f"select id, {CREATED} create_time, cluster_id, is_core::int is_core from labels_", eps=0.65, ms=5))
def c8(t):
    labels = global_labels(t, eps=0.65, min_samples=5)
    return labels.select("id", "create_time", "cluster_id", "is_core")


_PRESET_ROWS = ", ".join(f"({i}, '{n}', {e}, {m})" for i, (n, (e, m)) in enumerate(PRESETS.items()))


@query("c9_presets", with_views(
    f"select p.name preset, ev.cluster_id, article_count, total_weight, hot_score, article_ids "
    "from ev join presets p on p.n = ev.k",
    f"""presets as (select * from (values {_PRESET_ROWS}) x(n, name, eps, ms)),
    cand as materialized (
      select p.n k, id, create_time, p.eps + 0.2 eps, p.ms ms, cast(null as bigint) cap, cast(embedding as double[]) u
      from articles, clock, presets p
      where embedding is not null and create_time >= clock.t - interval 720 hour)""" + LABELS + EVENTS))
def c9(t):
    """All presets over one set of packed vectors; shifted by 0.2, where these vectors have clusters."""
    shifted = {name: (eps + 0.2, m) for name, (eps, m) in PRESETS.items()}
    rows = C.cluster_presets(t.articles, t.as_of, 720, shifted)
    return rows.select("preset", "cluster_id", "article_count", "total_weight", "hot_score", "article_ids")


_WINDOW_ROWS = ", ".join(
    f"({i}, '{n}', {e}, {m}, {h * 10})" for i, (n, (e, m, h)) in enumerate(WINDOW_PRESETS.items()))


@query("c9_preset_windows", with_views(
    f"select p.name preset, {EVENT} from ev join presets p on p.n = ev.k",
    f"""presets as (select * from (values {_WINDOW_ROWS}) x(n, name, eps, ms, hours)),
    cand as materialized (
      select p.n k, id, create_time, p.eps + 0.2 eps, p.ms ms, cast(null as bigint) cap, cast(embedding as double[]) u
      from articles, clock, presets p
      where embedding is not null and create_time >= clock.t - to_hours(p.hours))""" + LABELS + EVENTS))
def c9_windows(t):
    """Every preset over every window length, each pair of articles compared once; eps is shifted by 0.2 and hours
    are ten times as many, where these articles have clusters."""
    presets = {name: (eps + 0.2, m, 10 * hours) for name, (eps, m, hours) in WINDOW_PRESETS.items()}
    return C.cluster_presets(t.articles, t.as_of, presets=presets, block_rows=512).select("preset", *EVENT_COLUMNS)


@query("c6_factored_pool", ORACLES["c6_tenant_clusters"])
def c6_factored(t):
    """The shared pool compared once for all tenants, whatever their windows, distances and caps."""
    rows = candidates(t)
    recent = filters.within_hours(filters.not_deleted(filters.embedded(t.articles)), t.as_of, 720)
    found = shared_labels(rows, recent.select("id", "embedding"), ["system_id"]).labels
    return C.summarize(found, recent, ["system_id"]).select("system_id", *EVENT_COLUMNS)


@query("d2s_distinct_labels", tenant_sql("select distinct k system_id, cluster_id from labels_ where cluster_id >= 0"))
def d2s(t):
    return tenant_labels(t).select("system_id", "cluster_id").filter("cluster_id >= 0").distinct()


# -- the same over many small blocks, with components in rounds ------------------------------

GRID = {"block_rows": 64, "task_edges": 0}


@query("c2_core_points_grid", ORACLES["c2_core_points"])
def c2_grid(t):
    return global_labels(t, **GRID).select("id", "is_core")


@query("c3_components_rounds", ORACLES["c3_components"])
def c3_rounds(t):
    return connected_components(stage(_customer_graph(t), "edges"), ["system_id"], task_edges=0).select("id", "root")


@query("c4_numbered_labels_grid", ORACLES["c4_numbered_labels"])
def c4_grid(t):
    return tenant_labels(t, **GRID).select("system_id", "id", "cluster_id", "is_core")


@query("c6_tenant_clusters_grid", ORACLES["c6_tenant_clusters"])
def c6_grid(t):
    return tenant_events(t, **GRID).select("system_id", *EVENT_COLUMNS)


@query("c8_point_labels_grid", ORACLES["c8_point_labels"])
def c8_grid(t):
    labels = global_labels(t, eps=0.65, min_samples=5, **GRID)
    return labels.select("id", "create_time", "cluster_id", "is_core")


@query("c6_day_partitions", ORACLES["c6_tenant_clusters"])
def c6_days(t):
    """Over an article table partitioned by day, of which each scan reads the window's days."""
    path = scratch_path(t.spark, "articles")
    ingest.write_articles(t.articles, path)
    days = ingest.read_articles(t.spark, path, keep_day=True)
    events = C.cluster_events(days, t.links, t.active_systems, t.configs, t.as_of)
    return events.select("system_id", *EVENT_COLUMNS)


# -- aggregates over clusters ----------------------------------------------------------------


def _clustered(t):
    labels = tenant_labels(t).filter("cluster_id >= 0")
    return labels.join(t.articles.select("id", "title", "weight"), "id")


@query("a1_cluster_sizes", tenant_sql("select k system_id, cluster_id, count(*) article_count from clustered group by all"))
def a1(t):
    return tenant_labels(t).filter("cluster_id >= 0").groupBy("system_id", "cluster_id").agg(
        F.count("*").alias("article_count")
    )


@query("a2_cluster_weights", tenant_sql("select k system_id, cluster_id, total_weight from ev"))
def a2(t):
    return _clustered(t).groupBy("system_id", "cluster_id").agg(
        F.sum(cluster_weight(F.col("weight"))).cast("decimal(16,4)").alias("total_weight")
    )


@query("a3_newest_title", tenant_sql("select k system_id, cluster_id, title from ev"))
def a3(t):
    rows = _clustered(t)
    age = age_micros(F.col("create_time"), rows.schema["create_time"].dataType)
    return rows.groupBy("system_id", "cluster_id").agg(
        F.min_by("title", F.struct(age.alias("age"), F.col("id"))).alias("title")
    )


@query("a4_members_and_samples", tenant_sql("select k system_id, cluster_id, article_ids, sample_titles from ev"))
def a4(t):
    return tenant_events(t).select("system_id", "cluster_id", "article_ids", "sample_titles")


@query("n1_rank_events", tenant_sql("select k system_id, rank_no, cluster_id, hot_score from ev"))
def n1(t):
    return C.rank_events(tenant_events(t), ["system_id"]).select("system_id", "rank_no", "cluster_id", "hot_score")


@query("n2_recency_numbers", tenant_sql("select k system_id, id, rn from pts"))
def n2(t):
    rows = newest_per_key(stage(candidates(t), "candidates"), ["system_id"])
    return recency_numbers(rows.select("system_id", "id", "create_time"), ["system_id"]).drop("create_time")


@query("l1_newest_per_tenant", tenant_sql("select k system_id, id from pts where rn <= 50"))
def l1(t):
    rows = stage(candidates(t).withColumn("cap", F.least("cap", F.lit(50).cast("long"))), "candidates")
    return newest_per_key(rows, ["system_id"]).select("system_id", "id")


@query("l2_top_events", tenant_sql(
    "select k system_id, rank_no, cluster_id, hot_score from ev join configs c on c.system_id = k where rank_no <= c.snapshot_limit"))
def l2(t):
    ranked = C.rank_events(E.with_limits(tenant_events(t), t.configs), ["system_id"], "snapshot_limit")
    return ranked.select("system_id", "rank_no", "cluster_id", "hot_score")


@query("o1_order_by_score", global_sql("select cluster_id, hot_score from ev order by hot_score desc, cluster_id"))
def o1(t):
    return global_events(t).orderBy(F.col("hot_score").desc(), "cluster_id").select("cluster_id", "hot_score")


# -- live queries ----------------------------------------------------------------------------


@query("q1_live_events_tenant", tenant_sql(f"select k system_id, rank_no, {EVENT} from ev where rank_no <= 20"))
def q1(t):
    return C.rank_events(tenant_events(t), ["system_id"], 20).select("system_id", "rank_no", *EVENT_COLUMNS)


@query("q2_live_events_global", global_sql(f"select rank_no, {EVENT} from ev where rank_no <= 20"))
def q2(t):
    return C.rank_events(global_events(t), ["system_id"], 20).select("rank_no", *EVENT_COLUMNS)


Q6 = tenant_sql(
    f"select {ARTICLE} from articles where id in (select id from labels_ where k = 1 and cluster_id = 0) "
    "order by articles.weight desc, articles.create_time desc, id limit 50", hours="720")


@query("q6_live_event_articles", Q6)
def q6(t):
    """The events of all tenants are given; only those of the asked tenant count."""
    return article(E.live_event_articles(tenant_events(t, hours=720), t.articles, 1, 0, 50))


@query("q6_live_drill_down", Q6)
def q6_live(t):
    return article(
        E.live_drill_down(t.articles, t.links, t.active_systems, t.configs, t.as_of, 1, 0, hours=720)
    )


@query("j6_unnest_members", tenant_sql("select k system_id, cluster_id, place - 1 as position, id article_id from clustered"))
def j6(t):
    rows = unnest_articles(tenant_events(t).select("system_id", "cluster_id", "article_ids"))
    return rows.select("system_id", "cluster_id", F.col("position").cast("long").alias("position"), "article_id")


@query("e5_sql_view", tenant_sql(
    "select k system_id, count(*) events, cast(sum(article_count) as bigint) articles, max(hot_score) hottest from ev group by k"))
def e5(t):
    tenant_events(t).createOrReplaceTempView("hot_event_clusters")
    return t.spark.sql(
        "select system_id, count(*) events, sum(article_count) articles, max(hot_score) hottest "
        "from hot_event_clusters group by system_id"
    )


@query("s4_backfill", ticks_sql(f"""
select k % 100 system_id, {TIME.format('tick.at_time')} tick, {EVENT} from ev join tick on tick.n = k // 100
"""))
def s4(t):
    minutes = 240 * 60
    first = t.as_of - dt.timedelta(minutes=minutes)
    rows = C.backfill_events(t.articles, t.links, t.active_systems, t.configs, first, 2, minutes)
    return rows.select("system_id", "tick", *EVENT_COLUMNS)


_OVERLAPPING = {"ticks": 12, "step": 60}


@query("s4_backfill_overlapping", ticks_sql(f"""
select k % 100 system_id, {TIME.format('tick.at_time')} tick, {EVENT} from ev join tick on tick.n = k // 100
""", **_OVERLAPPING))
def s4_overlapping(t):
    """Twelve ticks whose windows have most of their articles in common; two articles meet once."""
    ticks, step = _OVERLAPPING["ticks"], _OVERLAPPING["step"] * 60
    first = t.as_of - dt.timedelta(minutes=step * (ticks - 1))
    rows = C.backfill_events(t.articles, t.links, t.active_systems, t.configs, first, ticks, step, block_rows=512)
    return rows.select("system_id", "tick", *EVENT_COLUMNS)


# -- stored snapshots ------------------------------------------------------------------------

SNAP = f"system_id, {SEEN} snapshot_time, rank_no, cluster_id, title, article_count, total_weight, hot_score, sample_titles, hours_window, 'token-hash-64' model_name"
SNAP_COLUMNS = (
    "system_id snapshot_time rank_no cluster_id title article_count total_weight hot_score sample_titles hours_window model_name"
).split()
LATEST = "snapshot_time = (select max(snapshot_time) from snap x where x.system_id = snap.system_id)"


@query("p12_snapshot_at_time", stored_sql(f"select {SNAP} from snap where snapshot_time = (select min(at_time) from tick)"))
def p12(t):
    at = moment(t.as_of - dt.timedelta(hours=240), t.articles)
    return E.at_time(t.store.snapshot, at).select(*SNAP_COLUMNS)


@query("p13_display", stored_sql("""
select system_id, rank_no as position, title hot_event, article_count reports, total_weight,
       cast(round(cast(hot_score as decimal(18,6)), 2) as double) heat, sample_titles related_titles
from snap"""))
def p13(t):
    return E.display(t.store.snapshot)


@query("j4_snapshot_members", stored_sql(f"""
select s.system_id, {TIME.format('s.snapshot_time')} snapshot_time, s.rank_no, a.id, a.title, cast(a.weight as double) weight
from snap s join snap_articles m using (system_id, snapshot_time, rank_no) join articles a on a.id = m.article_id
"""))
def j4(t):
    rows = E.event_members(t.store.snapshot, t.store.event_articles, t.articles.select("id", "system_id", "title", "weight"))
    return rows.select("system_id", "snapshot_time", "rank_no", "id", "title", "weight")


@query("j5_member_weights", stored_sql(f"select system_id, {SEEN} snapshot_time, rank_no, cluster_id, article_id, article_weight from snap_articles"))
def j5(t):
    return t.store.event_articles.select(
        "system_id", "snapshot_time", "rank_no", "cluster_id", "article_id", "article_weight"
    )


OVERVIEW = f"""
select s.system_id, s.system_code, s.system_name, {SEEN} snapshot_time, rank_no, cluster_id, title,
       article_count, total_weight, hot_score, sample_titles
from active s join snap using (system_id)"""


@query("j8_tenants_with_snapshots", stored_sql(OVERVIEW))
def j8(t):
    return E.overview(t.systems, t.store.snapshot)


@query("q8_overview", stored_sql(OVERVIEW))
def q8(t):
    return E.overview(t.systems, t.store.snapshot)


@query("o3_overview_order", stored_sql(f"""
select system_code, {SEEN} snapshot_time, rank_no from active join snap using (system_id)
order by system_code, snap.snapshot_time desc, rank_no"""))
def o3(t):
    return E.overview(t.systems, t.store.snapshot).select("system_code", "snapshot_time", "rank_no")


@query("a8_latest_times", stored_sql(f"select system_id, {TIME.format('max(snapshot_time)')} snapshot_time from snap group by system_id"))
def a8(t):
    return E.latest_time(t.store.snapshot)


@query("a10_monitoring", stored_sql(f"""
select 'pending_embeddings' metric, count(*) n from articles, clock where {PENDING}
union all select 'snapshot_rows', count(*) from snap"""))
def a10(t):
    return monitoring_counts(t.articles, t.store.snapshot, t.as_of)


@query("a11_unowned_rows", stored_sql("""
select 'articles' table_name, count(*) migrated from articles where system_id is null
union all select 'snapshot', 0 union all select 'event_articles', 0"""))
def a11(t):
    return unowned_counts(articles=t.articles, snapshot=t.store.snapshot, event_articles=t.store.event_articles)


@query("q3_latest_per_tenant", stored_sql(f"select {SNAP} from snap where {LATEST} and rank_no <= 10"))
def q3(t):
    return E.latest_per_tenant(t.store.snapshot, 10).select(*SNAP_COLUMNS)


@query("q4_latest_global", stored_sql(
    f"select {SNAP} from snap where snapshot_time = (select max(snapshot_time) from snap) order by rank_no, system_id limit 20"))
def q4(t):
    return E.latest_global(t.store.snapshot, limit=20).select(*SNAP_COLUMNS)


@query("q5_snapshot_event_articles", stored_sql(f"""
select {ARTICLE} from articles where is_deleted = false and id in (
  select article_id from snap_articles x where system_id = 1 and rank_no = 1
  and snapshot_time = (select max(snapshot_time) from snap where system_id = 1))
order by articles.weight desc, articles.create_time desc, id limit 50"""))
def q5(t):
    store = t.store
    rows = E.snapshot_event_articles(store.snapshot, store.event_articles, t.articles, 1, 1, 50)
    return article(rows.withColumn("system_id", F.col("owner_id")))


@query("q7_top_event_members", stored_sql(f"""
select s.system_id, s.rank_no, s.title event_title, a.id, a.title, a.source, cast(a.weight as double) weight, {TIME.format('a.create_time')} create_time
from snap s join snap_articles m using (system_id, snapshot_time, rank_no) join articles a on a.id = m.article_id
where s.snapshot_time = (select max(snapshot_time) from snap) and s.rank_no = 1"""))
def q7(t):
    store = t.store
    top = E.latest_global(store.snapshot, rank_no=1).withColumnRenamed("title", "event_title")
    members = E.event_members(top, store.event_articles, t.articles, ("event_title",))
    return members.select("system_id", "rank_no", "event_title", "id", "title", "source", "weight", "create_time")
