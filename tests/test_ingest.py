"""Continuous ingest of article files."""

import json

from newsburst.streaming import jobs


def test_records_without_an_id_are_all_kept(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    posted = [{"title": "a"}, {"title": "a"}, {"title": "b", "id": 1}, {"title": "b", "id": 1}, {"title": " "}, {"title": " "}]
    for run in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [*map(json.dumps, posted), "not json", "{cut off"]
        (tmp_path / "in" / f"{run}.json").write_text("\n".join(lines))
        jobs.ingest_stream(spark, source, target, checkpoint).awaitTermination()
    stored = spark.read.parquet(target)
    assert sorted((r.title, r.id) for r in stored.collect() if r.id) == [("b", 1)]
    assert stored.filter("id is null and title = 'a'").count() == 4
    rejected = spark.read.parquet(f"{target}_rejected")
    assert rejected.count() == 8 and rejected.filter("title is null").count() == 4
    assert stored.columns == [c for c in rejected.columns if c != "errors"]


def test_ids_that_come_again_late_are_stored_once(spark, tmp_path):
    """Each run is a micro-batch of its own; ids of all earlier ones are known, without state."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    runs = [
        [{"title": "first", "id": 5}, {"title": " ", "id": 6}, {"title": "x"}],
        [{"title": "other", "id": 9}],
        [{"title": "again", "id": 5}, {"title": "now valid", "id": 6}, {"title": "again", "id": 9}, {"title": "x"}, {"title": "low", "id": 1}],
        [{"title": " ", "id": 6}, {"title": " ", "id": 7}, {"title": "x"}],
    ]
    for run, posted in enumerate(runs):
        (tmp_path / "in" / f"{run}.json").write_text("\n".join(map(json.dumps, posted)))
        jobs.ingest_stream(spark, source, target, checkpoint).awaitTermination()
    stored = sorted((r.id or 0, r.title) for r in spark.read.parquet(target).collect())
    assert stored == [(0, "x")] * 3 + [(1, "low"), (5, "first"), (6, "now valid"), (9, "other")]
    assert sorted(r.id for r in spark.read.parquet(f"{target}_rejected").collect()) == [6, 7]


def test_a_batch_that_runs_again_is_not_compared_with_itself(spark, tmp_path):
    path = str(tmp_path / "stored")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c"), (4, "d")], "id long, title string")
    assert jobs.unseen(rows, path, 0).count() == 4
    spark.createDataFrame([(1, "a")], "id long, title string").write.parquet(f"{path}/batch=3")
    assert jobs.unseen(rows, path, 3).count() == 4
    assert sorted(r.title for r in jobs.unseen(rows, path, 4).collect()) == ["c", "c", "d"]
    assert jobs.unseen(rows.filter("id is null"), path, 4).count() == 2 and jobs.unseen(rows.limit(0), path, 4).count() == 0
