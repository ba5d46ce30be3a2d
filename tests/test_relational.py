import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsburst.functions import scalars
from newsburst.operators import articles as A
from newsburst.operators import filters, stats, tenants, visibility
from newsburst.sources import ingest


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_window_bounds(make):
    hour, day = dt.timedelta(hours=1), dt.timedelta(days=1)
    rows = make.articles(
        [
            {"id": 1, "create_time": make.as_of - 24 * hour},
            {"id": 2, "create_time": make.as_of - 24 * hour - dt.timedelta(microseconds=1)},
            {"id": 3, "create_time": make.as_of + hour},
            {"id": 4, "create_time": make.as_of - 60 * day},
            {"id": 5, "create_time": make.as_of - 60 * day + dt.timedelta(microseconds=1)},
        ]
    )
    assert ids(filters.within_hours(rows, make.as_of, 24)) == [1, 3]
    assert ids(filters.pending_embedding(rows, make.as_of)) == [1, 2, 3, 5]


def test_pending_placeholder_and_flags(make):
    rows = make.articles(
        [
            {"id": 1, "embedding": None},
            {"id": 2, "embedding": [0.0]},
            {"id": 3, "embedding": [0.5, 0.5], "is_deleted": None},
            {"id": 4, "embedding": [1.0], "is_deleted": True},
        ]
    )
    assert ids(filters.pending_embedding(rows, make.as_of)) == [1, 2]
    assert ids(filters.not_deleted(rows)) == [1, 2]


def test_filters_reach_the_scan(spark, make, tmp_path):
    make.articles([{"id": 1}]).write.parquet(str(tmp_path / "a"))
    rows = filters.article_filters(spark.read.parquet(str(tmp_path / "a")), source="x", min_weight=2)
    plan = rows.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,x)" in plan and "GreaterThanOrEqual(weight" in plan
    assert "full_text" not in plan


def test_visibility(make):
    rows = make.articles(
        [
            {"id": 1, "system_id": 1},
            {"id": 2, "system_id": 2},
            {"id": 3, "system_id": 2, "is_shared": True},
            {"id": 4, "system_id": None, "is_shared": True},
            {"id": 5, "system_id": None},
            {"id": 6, "system_id": None, "is_shared": None},
            {"id": 7, "system_id": 1, "is_shared": True},
        ]
    )
    links = make.links([(2, 1), (2, 1), (5, 1), (1, 1), (3, 1), (4, 2)])
    one = [1, 2, 3, 5, 7]
    assert ids(visibility.visible_to(rows, links, 1)) == one
    pairs = visibility.visible_pairs(rows.select("id", "system_id", "is_shared"), links, make.systems(1, 2, 3))
    got = sorted((r["system_id"], r["id"]) for r in pairs.collect())
    assert got == [(1, i) for i in one] + [(2, i) for i in (2, 3, 4, 7)] + [(3, 3), (3, 7)]


def test_visible_stats_equal_counted_pairs(make):
    rows = make.articles(
        [{"id": i, "system_id": i % 3 or None, "is_shared": i % 2 == 0, "is_deleted": i % 5 == 0} for i in range(1, 30)]
    )
    links = make.links([(i, 2) for i in range(1, 30, 4)] + [(3, 1), (3, 1)])
    systems = make.systems(1, 2, 3, 4, inactive=(4,))
    got = {r["system_id"]: r for r in stats.visible_stats(systems, rows, links).collect()}
    assert sorted(got) == [1, 2, 3]
    for s in got:
        visible = visibility.visible_to(rows, links, s)
        assert got[s]["total_articles"] == visible.count()
        assert got[s]["shared_articles"] == visible.filter("is_shared").count()
        assert got[s]["active_articles"] == visible.filter("is_deleted = false").count()


def test_vector_text(spark):
    rows = spark.createDataFrame([("[1, 2.5]",), ("{1,2.5}",), ("3",), ("[]",)], "s STRING")
    got = [r[0] for r in rows.select(scalars.parse_vector(F.col("s"))).collect()]
    assert got == [[1.0, 2.5], [1.0, 2.5], [3.0], []]


def test_score_and_weights(spark):
    row = spark.sql("select cast(3.5 as decimal(16,4)) w, 3L n, cast(0 as decimal(16,4)) z, cast(null as decimal(16,4)) m")
    got = row.select(
        scalars.hot_score(F.col("w"), F.col("n")),
        scalars.cluster_weight(F.col("z")),
        scalars.cluster_weight(F.col("m")),
        scalars.link_weight(F.col("z")),
        scalars.link_weight(F.col("m")),
    ).first()
    assert got[0] == 12.187708
    assert [float(v) for v in got[1:]] == [1, 1, 0, 1]


def test_normalize_keeps_zero(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v ARRAY<DOUBLE>")
    got = [r[0] for r in rows.select(scalars.l2_normalize(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_validation(make):
    rows = make.articles(
        [
            {"id": 1},
            {"id": 2, "title": "  "},
            {"id": 3, "weight": None},
            {"id": 4, "weight": 0, "title": ""},
            {"id": 5, "embedding": [1.0, 2.0]},
        ]
    )
    accepted, rejected = ingest.validate(rows, dimension=3)
    assert ids(accepted) == [1]
    assert {r["id"]: len(r["errors"]) for r in rejected.collect()} == {2: 1, 3: 1, 4: 2, 5: 1}


def test_metadata_round_trip(spark):
    text = '{"author":"a","tags":["x","y"],"publishTime":"2024-01-02T03:04:05Z","viewCount":7,"other":1}'
    rows = spark.createDataFrame([(text,)], "t STRING").select(scalars.decode_metadata(F.col("t")).alias("m"))
    m = rows.first()["m"]
    assert (m["author"], m["tags"], m["viewCount"], m["likeCount"]) == ("a", ["x", "y"], 7, None)
    assert m["publishTime"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    again = rows.select(scalars.encode_metadata(F.col("m"))).first()[0]
    assert '"publishTime":"2024-01-02T03:04:05Z"' in again


def test_export_round_trip(spark, make, tmp_path):
    rows = make.articles(
        [
            {"id": 1, "title": 'a "quoted", title', "full_text": "two\nlines", "embedding": [0.25, -1.5]},
            {"id": 2, "summary": "", "weight": 2.5, "system_id": None},
        ]
    )
    ingest.write_export(rows, str(tmp_path / "x"))
    back = ingest.read_export(spark, str(tmp_path / "x"))
    assert sorted(back.collect()) == sorted(rows.collect())


def test_day_partitions_are_pruned(spark, make, tmp_path):
    rows = make.articles([{"id": i, "create_time": make.as_of - dt.timedelta(days=i)} for i in range(10)])
    ingest.write_articles(rows, str(tmp_path / "t"))
    recent = ingest.read_articles(spark, str(tmp_path / "t"), make.as_of, 48)
    assert ids(filters.within_hours(recent, make.as_of, 48)) == [0, 1, 2]
    assert "PartitionFilters: [isnotnull(create_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_share_and_unshare(make):
    links = make.links([(1, 1)])
    wanted = make.links([(1, 1), (1, 2), (1, 2), (9, 2)])
    table, rejected = A.share(links, wanted, make.articles([{"id": 1}]))
    assert sorted(map(tuple, table.collect())) == [(1, 1), (1, 2)]
    assert [tuple(r) for r in rejected.collect()] == [(9, 2)]
    assert A.unshare(table, article_ids=make.links([(1, 0)])).count() == 0


def test_config_changes_keep_what_is_not_given(spark, make):
    configs = make.configs((1, 24, 0.38, 3, 80000, 100))
    changes = spark.createDataFrame([(1, None, 0.5)], "system_id BIGINT, default_hours INT, default_eps DOUBLE")
    row = tenants.merge_configs(configs, changes).first()
    assert (row["default_hours"], row["default_eps"], row["default_min_samples"]) == (24, 0.5, 3)


def test_migration_needs_a_default_tenant(make):
    with pytest.raises(ValueError):
        tenants.migrate_to_default(make.systems(1), make.articles([{"id": 1, "system_id": None}]))
