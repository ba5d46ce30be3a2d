"""What must hold as tables grow: no hidden caps, pruned scans, a store that does not grow."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsburst.functions import scalars
from newsburst.operators import cluster as C
from newsburst.operators import events as E
from newsburst.operators import tenants as T
from newsburst.operators.articles import unknown_ids, update_weights
from newsburst.operators.dbscan import neighbour_counts, newest_per_key, recency_numbers
from newsburst.operators.visibility import visible_to
from newsburst.session import spread
from newsburst.sources import ingest
from newsburst.sources.store import SnapshotStore
from newsburst.streaming import jobs


def group(make, first, n, system_id=1, minutes=0, vector=(1.0, 0.0)):
    at = make.as_of - dt.timedelta(minutes=minutes)
    return [{"id": first + i, "system_id": system_id, "embedding": list(vector), "create_time": at} for i in range(n)]


def test_no_cap_unless_given(spark, make):
    params = C.resolve_parameters(make.systems(1, 2, 3), make.configs((1, 24, 0.4, 2, 0, 5), (2, 24, 0.4, 2, None, 5), (3, 24, 0.4, 2, 7, 5)))
    assert {r.system_id: r.cap for r in params.collect()} == {1: None, 2: None, 3: 7}
    rows = make.articles(group(make, 0, 30)).select(F.col("system_id"), "id", "create_time")
    capped = rows.withColumn("cap", F.lit(None).cast("long"))
    assert newest_per_key(capped, ["system_id"]).count() == 30
    events = C.cluster_events_global(make.articles(group(make, 0, 30)), make.as_of)
    assert events.first().article_count == 30


def test_shared_pool_is_cut_to_whole_minutes(spark, make):
    rows = [r | {"is_shared": True} for m in range(6) for r in group(make, 100 * m, 4, system_id=1, minutes=m)]
    articles, systems = make.articles(rows), make.systems(1, 2)
    configs = make.configs((1, 24, 0.4, 2, 6, 5), (2, 24, 0.4, 2, 3, 5))
    scopes = C.scopes(systems, configs)
    pairs = C.tenant_candidates(articles, spark.createDataFrame([], "article_id long, system_id long"), scopes, make.as_of)
    assert pairs.groupBy("system_id").count().orderBy("system_id").collect() == [(1, 8), (2, 8)]
    kept = newest_per_key(pairs, ["system_id"])
    assert kept.groupBy("system_id").count().orderBy("system_id").collect() == [(1, 6), (2, 3)]


@pytest.mark.parametrize("block_rows", [8192, 4])
def test_neighbour_counts(spark, make, block_rows):
    rows = group(make, 0, 5) + group(make, 10, 9, vector=(0.0, 1.0)) + group(make, 30, 1, vector=(-1.0, 0.01))
    articles = make.articles(rows)
    found = C.global_candidates(articles, make.as_of, eps=0.1)
    counts = neighbour_counts(found, articles.select("id", "embedding"), ["system_id"], block_rows=block_rows)
    assert {r.id: r.neighbours for r in counts.collect()} == {r["id"]: n for r, n in zip(rows, [5] * 5 + [9] * 9 + [1])}
    nothing = neighbour_counts(found.limit(0), articles.select("id", "embedding"), ["system_id"])
    assert nothing.count() == 0


def test_every_article_scan_prunes_days(spark, make, tmp_path):
    path = str(tmp_path / "articles")
    rows = [r for d in range(4) for r in group(make, 100 * d, 3, minutes=1440 * d)]
    ingest.write_articles(make.articles(rows), path)
    days = ingest.read_articles(spark, path, keep_day=True)
    recent = C.filters.within_hours(C.filters.embedded(days), make.as_of, 24)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(create_date" in plan
    events = C.cluster_events_global(days, make.as_of, hours=24)
    assert events.first().article_count == 6


def test_store_stays_small(spark, make, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    articles, links = make.articles(group(make, 0, 4)), spark.createDataFrame([], "article_id long, system_id long")
    systems, configs = make.systems(1), make.configs((1, 24, 0.4, 2, 0, 5))
    with pytest.raises(LookupError):
        store.snapshot  # noqa: B018
    files = []
    for i in range(5):
        at = scalars.moment(make.as_of + dt.timedelta(minutes=i), articles)
        snapshot, members = E.build_snapshot(articles, links, systems, configs, make.as_of, at, "m1")
        store.commit(snapshot, members, systems, at)
        files.append((len(store.snapshot.inputFiles()), len(list((tmp_path / "store" / "snapshot").iterdir()))))
    assert files[1:] == [files[1]] * 4 and files[0][0] == files[1][0]
    assert [r.model_name for r in store.snapshot.collect()] == ["m1"]
    assert store.event_articles.count() == 4


def test_only_due_tenants_are_refreshed(spark, make, tmp_path):
    articles = make.articles(group(make, 0, 3) + group(make, 10, 3, system_id=2))
    links = spark.createDataFrame([], "article_id long, system_id long")
    configs = make.configs((1, 24, 0.4, 2, 0, 5), (2, 24, 0.4, 2, 0, 5)).withColumn(
        "clustering_cron", F.when(F.col("system_id") == 1, "*/8 * * * *").otherwise("*/12 * * * *")
    )
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for n, minutes in enumerate((0, 10)):
        at = make.as_of + dt.timedelta(minutes=minutes)
        spark.createDataFrame([(at,)], "as_of timestamp").write.mode("append").parquet(str(tmp_path / "ticks"))
        ticks = spark.readStream.schema("as_of timestamp").parquet(str(tmp_path / "ticks"))
        load = lambda: (articles, links, make.systems(1, 2), configs)
        jobs.refresh_stream(ticks, store, str(tmp_path / "checkpoint"), load, every=None).awaitTermination()
    times = {r.system_id: r.snapshot_time for r in store.heads().collect()}
    assert times == {1: make.as_of + dt.timedelta(minutes=10), 2: make.as_of}


def test_tenants_do_not_mix_in_the_drill_down(spark, make):
    articles = make.articles(group(make, 10, 2) + group(make, 20, 2, system_id=2))
    links = spark.createDataFrame([], "article_id long, system_id long")
    systems, configs = make.systems(1, 2), make.configs((1, 24, 0.4, 2, 0, 5), (2, 24, 0.4, 2, 0, 5))
    events = C.cluster_events(articles, links, systems, configs, make.as_of)
    assert sorted(r.id for r in E.live_event_articles(events, articles, 2, 0).collect()) == [20, 21]
    live = E.live_drill_down(articles, links, systems, configs, make.as_of, 1, 0)
    assert sorted(r.id for r in live.collect()) == [10, 11]


def test_repeated_changes_and_keys(spark, make):
    changes = spark.createDataFrame([(1, 5), (1, 9), (1, 7), (99, 1)], "id long, weight int")
    articles = make.articles([{"id": 1}, {"id": 2}])
    assert {r.id: int(r.weight) for r in update_weights(articles, changes).collect()} == {1: 9, 2: 1}
    assert [r.id for r in unknown_ids(articles, changes).collect()] == [99]
    old = spark.createDataFrame([(1, "a")], "system_id long, system_code string")
    new = spark.createDataFrame([(7, "b"), (5, "b"), (6, "a")], "system_id long, system_code string")
    assert sorted(map(tuple, T.insert_if_absent(old, new, "system_code").collect())) == [(1, "a"), (5, "b")]


def test_blank_titles(spark, make):
    rows = [{"id": i, "title": t} for i, t in enumerate(["\t\n", " ", "", None, "x", "　"])]
    accepted, rejected = ingest.validate(make.articles(rows))
    assert sorted(r.id for r in accepted.collect()) == [4, 5] and rejected.count() == 4


def test_visible_articles(spark, make):
    articles = make.articles(
        [{"id": 1}, {"id": 2, "system_id": 2}, {"id": 3, "system_id": None, "is_shared": True},
         {"id": 4, "system_id": 2, "is_shared": True}, {"id": 5, "system_id": None, "is_shared": None}]
    )
    links = make.links([(2, 1), (2, 1), (5, 1), (1, 1)])
    assert sorted(r.id for r in visible_to(articles, links, 1).collect()) == [1, 2, 4, 5]


def test_norm_is_bound_once(spark):
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id int, v array<double>")
    got = {r.id: r.u for r in vectors.select("id", scalars.l2_normalize(F.col("v")).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}


def test_recency_numbers_share_out_a_hot_tenant(spark):
    """One tenant holds most rows, many with one time; its rows lie in several ranges and are numbered through."""
    at = dt.datetime(2024, 5, 1)
    rows = [(1, i, at if i % 2 else at - dt.timedelta(seconds=i % 97)) for i in range(3000)]
    rows += [(2, i, at - dt.timedelta(hours=i % 7)) for i in range(200)] + [(None, 1, at), (None, 2, None), (3, 1, at)]
    table = spark.createDataFrame(rows, "system_id long, id long, create_time timestamp_ntz").repartition(8)
    got = {(r.system_id, r.id): r.rn for r in recency_numbers(table, ["system_id"]).collect()}
    expected = {}
    for tenant in (1, 2, 3, None):
        own = [r for r in rows if r[0] == tenant]
        own.sort(key=lambda r: (-(r[2] - at).total_seconds() if r[2] else float("inf"), r[1]))
        expected |= {(tenant, r[1]): n for n, r in enumerate(own, 1)}
    assert got == expected
    assert recency_numbers(table.limit(0), ["system_id"]).count() == 0


def test_no_window_over_a_whole_tenant(spark):
    table = spark.range(10).selectExpr("1L system_id", "id", "timestamp_ntz'2024-05-01 00:00:00' create_time")
    plan = recency_numbers(table, ["system_id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line]
    assert windows and all("_range" in line for line in windows)


def test_member_weights_come_from_the_window(spark, make):
    rows = [r | {"weight": 3} for r in group(make, 0, 4)] + group(make, 50, 4, minutes=60 * 30)
    configs = make.configs((1, 24, 0.4, 2, 0, 5))
    links = spark.createDataFrame([], "article_id long, system_id long")
    at = F.lit(make.as_of).cast("timestamp_ntz")
    _, members = E.build_snapshot(make.articles(rows), links, make.systems(1), configs, make.as_of, at)
    assert sorted((r.article_id, float(r.article_weight)) for r in members.collect()) == [(i, 3.0) for i in range(4)]
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert any("create_time" in line and "Filter" in line for line in plan.splitlines())


def test_new_tenants_carry_their_times(spark, make):
    asked = spark.createDataFrame([("a", "A", "", 12), ("b", "B", "", None)], "system_code string, system_name string, description string, default_hours int")
    now, later = dt.datetime(2024, 5, 1, 12), dt.datetime(2024, 5, 2, 12)
    systems, configs, errors = T.create_tenants(make.systems(1), asked, now)
    assert errors.isEmpty()
    for made in (systems, configs):
        assert made.selectExpr("create_time = update_time AND create_time = timestamp'2024-05-01 12:00:00' AS same").distinct().collect() == [(True,)]
    first = configs.agg(F.min("system_id")).first()[0]
    changed = T.merge_configs(configs, spark.createDataFrame([(first, 48)], "system_id long, default_hours int"), later)
    times = {r.system_id == first: (r.create_time.day, r.update_time.day) for r in changed.collect()}
    assert times == {True: (1, 2), False: (1, 1)}


def test_spread_goes_by_size(spark, tmp_path, monkeypatch):
    """A large table in one file is cut into more tasks than there are cores, a small one is not."""
    path = str(tmp_path / "one")
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr("newsburst.session.SPREAD_BYTES", 1 << 40, raising=False)
    assert spread(rows).rdd.getNumPartitions() == cores
    monkeypatch.setattr("newsburst.session.SPREAD_BYTES", 1 << 18, raising=False)
    parts = spread(rows)
    assert parts.rdd.getNumPartitions() > 2 * cores and parts.distinct().count() == 200_000
