import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsburst.operators import cluster as C
from newsburst.operators import encode as N
from newsburst.operators import events as E
from newsburst.sources.store import SnapshotStore
from newsburst.streaming import jobs


def story(angle, count, first_id, start, **columns):
    """``count`` near-equal articles about one thing, newest first."""
    rows = []
    for i in range(count):
        a = np.radians(angle + 0.01 * i)
        rows.append(
            {
                "id": first_id + i,
                "title": f"t{first_id + i}",
                "embedding": [float(np.cos(a)), float(np.sin(a))],
                "create_time": start - dt.timedelta(minutes=i),
                **columns,
            }
        )
    return rows


@pytest.fixture
def world(make):
    old = make.as_of - dt.timedelta(hours=2)
    articles = make.articles(
        story(0, 5, 100, make.as_of, weight=2)
        + story(60, 3, 200, old, weight=0)
        + story(90, 4, 300, old, system_id=2)
        + story(150, 2, 400, old, system_id=3)
    )
    links = make.links([])
    systems = make.systems(1, 2, 3)
    configs = make.configs(
        (1, 24, 0.01, 3, 0, 100), (2, 24, 0.01, 3, 80000, 100), (3, 24, 0.01, 3, 80000, 100)
    )
    return articles, links, systems, configs


def test_summary(make, world):
    rows = C.rank_events(C.cluster_events(*world, make.as_of), ["system_id"]).collect()
    got = {(r["system_id"], r["rank_no"]): r for r in rows}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1)]
    top, low = got[(1, 1)], got[(1, 2)]
    assert (top["cluster_id"], top["article_count"], float(top["total_weight"])) == (0, 5, 10.0)
    assert top["title"] == "t100" and top["sample_titles"] == "t100 | t101 | t102 | t103"
    assert top["article_ids"] == [100, 101, 102, 103, 104]
    assert float(low["total_weight"]) == 3.0  # zero weights count as one
    assert float(top["hot_score"]) == round(10 * np.log2(6) ** 1.8, 6)


def test_equal_scores_rank_by_cluster(make):
    rows = make.articles(story(0, 3, 1, make.as_of) + story(90, 3, 10, make.as_of - dt.timedelta(hours=1)))
    events = C.cluster_events_global(rows, make.as_of, 24, 0.01, 3)
    ranked = C.rank_events(events, ["system_id"]).orderBy("rank_no").collect()
    assert [r["cluster_id"] for r in ranked] == [0, 1]
    assert ranked[0]["hot_score"] == ranked[1]["hot_score"]


def test_global_keeps_deleted_rows_and_tenant_does_not(make, world):
    articles, links, systems, configs = world
    deleted = articles.withColumn("is_deleted", F.col("system_id") == 1)
    assert C.cluster_events_global(deleted, make.as_of, 24, 0.01, 3).count() == 3
    events = C.cluster_events(deleted, links, systems, configs, make.as_of).collect()
    assert [r["system_id"] for r in events] == [2]


def test_missing_config(make, world):
    articles, links, _, configs = world
    with pytest.raises(C.MissingConfig):
        C.cluster_events(articles, links, make.systems(1, 9), configs, make.as_of)


def test_store_refresh(spark, make, world, tmp_path):
    articles, links, systems, configs = world
    store = SnapshotStore(spark, str(tmp_path / "store"))
    first = F.lit(make.as_of)
    store.commit(*E.build_snapshot(*world, make.as_of, first), systems, first)
    assert store.snapshot.groupBy("system_id").count().orderBy("system_id").collect() == [(1, 2), (2, 1)]
    assert store.event_articles.filter("article_id = 200").first()["article_weight"] == 0
    before = sorted(store.snapshot.filter("system_id = 2").collect())

    gone = articles.filter("system_id <> 1")
    one = systems.filter("system_id = 1")
    later = F.lit(make.as_of + dt.timedelta(minutes=12))
    new, members = E.build_snapshot(gone, links, one, configs, make.as_of, later)
    replaced = E.replace_tenants(store.snapshot, new, one)
    store.commit(new, members, one, later)
    assert sorted(store.snapshot.collect()) == before == sorted(replaced.select(store.snapshot.columns).collect())
    assert store.event_articles.filter("system_id = 1").count() == 0


def test_store_history(spark, make, world, tmp_path):
    articles, links, systems, configs = world
    store = SnapshotStore(spark, str(tmp_path / "store"))
    ranked = E.with_limits(C.rank_events(C.cluster_events(*world, make.as_of), ["system_id"]), configs)
    for step in range(3):
        at = F.lit(make.as_of + dt.timedelta(minutes=step))
        store.commit(E.snapshot_rows(ranked, at), E.event_article_rows(ranked, articles, at), systems, at, keep=2)
    times = [r[0] for r in store.snapshot.select("snapshot_time").distinct().orderBy("snapshot_time").collect()]
    assert times == [make.as_of + dt.timedelta(minutes=s) for s in (1, 2)]
    latest = E.latest_per_tenant(store.snapshot)
    assert {r["snapshot_time"] for r in latest.collect()} == {times[-1]}
    assert E.keep_history(store.snapshot, 1).count() == latest.count() == 3


def test_snapshot_drill_down_order(make, world):
    articles, links, systems, configs = world
    heavy = articles.withColumn(
        "weight", F.when(F.col("id") == 103, F.lit(9)).otherwise(F.col("weight")).cast("decimal(16,4)")
    )
    snapshot, members = E.build_snapshot(heavy, links, systems, configs, make.as_of, F.lit(make.as_of))
    rows = E.snapshot_event_articles(snapshot, members, heavy, 1, 1, 3).collect()
    assert [r["id"] for r in rows] == [103, 100, 101]


def test_backfill_equals_single_runs(make, world):
    articles, links, systems, configs = world
    step = 60
    first = make.as_of - dt.timedelta(minutes=2 * step)
    rows = C.backfill_events(articles, links, systems, configs, first, 3, step).collect()
    for n in range(3):
        at = first + dt.timedelta(minutes=n * step)
        seen = articles.filter(F.col("create_time") <= F.lit(at))
        alone = C.cluster_events(seen, links, systems, configs, at).drop("system_id").collect()
        mine = [r for r in rows if r["tick"] == at]
        assert sorted(r["title"] for r in mine) == sorted(r["title"] for r in alone)
        assert sorted(map(tuple, (r["article_ids"] for r in mine))) == sorted(map(tuple, (r["article_ids"] for r in alone)))


def test_response_shapes(spark):
    good = [
        ("a", [1, 2], '{"embeddings": [[1, 0], [0, 1]], "dimension": 2}'),
        ("b", [3], '{"data": [{"embedding": [0.5, 0.5]}]}'),
        ("c", [4, 5], "[[1, 2], [3, 4]]"),
        ("d", [6], '[{"embedding": [7, 8]}]'),
    ]
    bad = [("e", [7, 8], "[[1, 2]]"), ("f", [9], '{"other": 1}'), ("g", [10], "no json")]
    frame = spark.createDataFrame(good + bad, "batch STRING, ids ARRAY<BIGINT>, response STRING")
    vectors, errors = N.decode_responses(frame)
    got = {r["id"]: r["embedding"] for r in vectors.collect()}
    assert got == {1: [1, 0], 2: [0, 1], 3: [0.5, 0.5], 4: [1, 2], 5: [3, 4], 6: [7, 8]}
    found = {r["batch"]: r["error"] for r in errors.collect()}
    assert sorted(found) == ["e", "f", "g"]
    assert found["e"] == "vector count differs from text count" and found["f"] == "unknown response shape"


def test_request_bodies(spark):
    docs = spark.range(7).selectExpr("id", "concat('text ', id) text").coalesce(1)
    rows = N.encoder_requests(docs, rows=3).collect()
    assert sorted(len(r["ids"]) for r in rows) == [1, 3, 3]
    assert all('"model"' not in r["body"] for r in rows)
    assert '"model":"m"' in N.encoder_requests(docs, model="m").first()["body"]


def test_encoder_must_answer_every_text(spark):
    docs = spark.range(3).selectExpr("id", "'x' text")
    with pytest.raises(Exception, match="encoder gave"):
        N.encode_batches(docs, lambda: lambda texts: [[1.0]] * (len(texts) + 1)).collect()


def test_sql_and_python_encoders_agree(spark):
    docs = spark.createDataFrame([(1, "a b  a。c\nd"), (2, "。。"), (3, "x" * 5000 + " y")], "id BIGINT, text STRING")
    sql = {r["id"]: r["embedding"] for r in N.hash_encode(N.token_rows(docs)).collect()}
    python = {r["id"]: r["embedding"] for r in N.encode_batches(docs, N.TokenHashEncoder).collect()}
    assert sorted(sql) == sorted(python) == [1, 2, 3]
    for i in sql:
        assert sql[i] == pytest.approx(python[i], abs=1e-6)


def test_due_tenants(spark, make):
    systems = make.systems(1, 2, 3, 4, inactive=(4,))
    schedule = spark.createDataFrame(
        [(i, "*/12 * * * *") for i in (1, 2, 3, 4)], "system_id BIGINT, cron STRING"
    ).select("system_id", jobs.interval_minutes("cron").alias("interval_minutes"))
    minutes = lambda m: make.as_of - dt.timedelta(minutes=m)
    last = spark.createDataFrame([(1, minutes(5)), (2, minutes(12))], "system_id BIGINT, snapshot_time TIMESTAMP")
    due = jobs.due_tenants(systems, schedule, last, F.lit(make.as_of)).collect()
    assert sorted(r[0] for r in due) == [2, 3]


def test_a_worker_holds_one_request_at_a_time(spark, make, monkeypatch):
    """Requests are groups of their own, not rows of one large batch; the answers stay the same."""
    plans = []
    real = N.stage
    monkeypatch.setattr(N, "stage", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or real(df, name))
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(7)], "id long, text string")

    def service():
        return lambda body: json.dumps({"embeddings": [[float(t[1:])] for t in json.loads(body)["texts"]]})

    vectors, failed = N.embed_through_requests(docs, service, rows=2)
    assert {r.id: r.embedding for r in vectors.collect()} == {i: [float(i)] for i in range(7)}
    assert failed.count() == 0
    assert "FlatMapGroupsInPandas" in plans[0] and "MapInPandas " not in plans[0].replace("FlatMapGroupsInPandas", "")
