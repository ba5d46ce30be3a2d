"""Scopes with rows in common: equal to each scope on its own, and each pair compared once."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsburst.operators import cluster as C
from newsburst.operators.dbscan import dbscan_labels
from newsburst.operators.neighbors import distance_levels
from newsburst.operators.shared import GraphStore, scope_labels, shared_labels

START = dt.datetime(2024, 1, 1)
CANDIDATES = "scope int, id long, create_time timestamp_ntz, eps double, min_samples int, cap long, share long"


def cloud(seed, n, copies=0, dim=3):
    """Vectors around few directions, some of them zero, some equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    found = centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, dim))
    found[:1] = 0
    for _ in range(copies):
        found[rng.integers(n)] = found[rng.integers(n)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(found.astype(np.float32))]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def check(spark, candidates, vectors, store=None, **options):
    """The result of the shared comparison, after a look at the labels of each scope on its own."""
    rows = spark.createDataFrame(candidates, CANDIDATES)
    points = spark.createDataFrame(vectors, "id long, embedding array<float>")
    found = shared_labels(rows, points, ["scope"], store, **options)
    assert rows_of(found.labels) == rows_of(dbscan_labels(rows, points, ["scope"]))
    return found


def at(i):
    return START - dt.timedelta(minutes=int(i))


@pytest.mark.parametrize("seed,block_rows", [(1, 8192), (2, 16)])
def test_scopes_of_any_rows(spark, seed, block_rows):
    rng = np.random.default_rng(seed)
    vectors = cloud(seed, 90, copies=25)
    options = [(0.02, 2), (0.05, 4), (0.05, 1), (0.3, 9), (0.11, 3)]
    candidates = []
    for scope, (eps, least) in enumerate(options):
        cap = [None, 30][scope % 2]
        for i, _ in vectors:
            if rng.random() < 0.8:
                # A third of the articles are private to two tenants each.
                share = scope // 2 if i % 3 == 0 else None
                candidates.append((scope, i, at(i // 4), eps, least, cap, share))
    found = check(spark, candidates, vectors, block_rows=block_rows, task_edges=0 if seed == 2 else 10**6)
    assert found.groups > 5


def test_nothing(spark):
    empty = spark.createDataFrame([], CANDIDATES)
    points = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    found = shared_labels(empty, points, ["scope"])
    assert found.labels.count() == found.pairs == 0
    assert found.labels.columns == ["scope", "id", "create_time", "is_core", "cluster_id"]
    assert scope_labels(empty, points, ["scope"]).count() == 0


def test_levels_of_distances():
    rows, cols = (np.array([v for _, v in cloud(s, 40)], np.float32) for s in (4, 5))
    levels = np.array([0.0, 0.1, 0.5, 1.2])
    unit = [x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1), 1e-300)[:, None] for x in (rows, cols)]
    distance = 1 - unit[0] @ unit[1].T
    assert (distance_levels(rows, cols, levels) == (distance[..., None] > levels).sum(axis=2)).all()


def test_a_pool_is_compared_once_for_all_tenants(spark, make):
    """Fifty tenants of several distances, windows and sizes see one pool and a few articles of their own."""
    n, tenants = 60, 50
    vectors = cloud(7, n + tenants)
    rows = [{"id": i, "embedding": v, "create_time": make.as_of - dt.timedelta(minutes=i), "is_shared": i < n,
             "system_id": 1 if i < n else i - n + 1} for i, v in vectors]
    articles, links = make.articles(rows), make.links([(n + 3, 9), (n + 4, 9)])
    systems = make.systems(*range(1, tenants + 1))
    configs = make.configs(*[(s, 24, (0.05, 0.2)[s % 2], 2 + s % 3, 0, 5) for s in range(1, tenants + 1)])
    candidates = C.tenant_candidates(articles, links, C.scopes(systems, configs), make.as_of)
    points = articles.select("id", "embedding")
    found = shared_labels(candidates, points, ["system_id"])
    assert rows_of(found.labels) == rows_of(dbscan_labels(candidates, points, ["system_id"]))
    # Distinct vectors of the pool against each other, and each tenant's own against the pool; its own, too.
    assert n * (n - 1) // 2 + tenants * n <= found.pairs <= n * (n - 1) // 2 + tenants * (n + 2) + 4 * n
    assert found.groups == 1 + tenants


def test_windows_of_presets_are_compared_once(spark, make):
    vectors = cloud(8, 120)
    rows = [{"id": i, "embedding": v, "create_time": make.as_of - dt.timedelta(hours=i)} for i, v in vectors]
    presets = {f"p{h}{m}": (0.02 * m, m, h) for h in (12, 24, 168) for m in (2, 3, 5)}
    candidates, recent = C.preset_candidates(make.articles(rows), make.as_of, presets)
    points = recent.select("id", "embedding")
    found = shared_labels(candidates, points, ["preset"])
    assert rows_of(found.labels) == rows_of(dbscan_labels(candidates, points, ["preset"]))
    assert found.groups == 3 and found.pairs == 120 * 119 // 2


def test_ticks_are_compared_as_their_union(spark, make):
    """Twenty ticks of overlapping windows, some with a cap."""
    n = 60
    vectors = cloud(9, n)
    rows = [{"id": i, "embedding": v, "create_time": make.as_of - dt.timedelta(minutes=30 * i), "is_shared": i % 2 == 0}
            for i, v in vectors]
    articles, links = make.articles(rows), make.links([(1, 2)])
    configs = make.configs((1, 24, 0.06, 2, 0, 5), (2, 12, 0.03, 3, 9, 5))
    first = make.as_of - dt.timedelta(hours=19)
    tenants = C.scopes(make.systems(1, 2), configs)
    candidates = C.backfill_candidates(articles, links, tenants, first, 20, 60)
    points, keys = articles.select("id", "embedding"), ["system_id", "tick"]
    found = shared_labels(candidates, points, keys)
    assert rows_of(found.labels) == rows_of(dbscan_labels(candidates, points, keys))
    assert found.pairs <= n * (n - 1) // 2


def window(vectors, first, last, eps=0.05, least=3):
    return [(s, i, at(-i), e, least, None, None) for i, _ in vectors if first <= i < last for s, e in ((0, eps), (1, 0.02))]


def test_a_later_run_compares_what_is_new(spark, tmp_path):
    """Two percent of the window come, two leave; then an article changes, one goes, parameters change."""
    n, new = 600, 6
    vectors = cloud(10, n + 40, copies=30)
    store, options = GraphStore(spark, str(tmp_path / "graph")), {"slice_rows": 16, "block_rows": 512}
    whole = check(spark, window(vectors, 0, n), vectors, store, **options)
    assert whole.pairs >= 0.9 * n * (n - 1) / 2
    again = check(spark, window(vectors, 0, n), vectors, store, **options)
    assert again.pairs == 0
    later = check(spark, window(vectors, 2 * new, n + 2 * new), vectors, store, **options)
    # The new rows and those in one slice with rows that have left, against the window.
    assert 2 * new * 0.9 * n <= later.pairs <= (4 * new + 32) * 1.1 * n

    changed = [(i, v[::-1] if i == 500 else v) for i, v in vectors]
    rows = [r for r in window(changed, 20, n + 20) if r[1] != 250]
    found = check(spark, rows, changed, store, **options)
    # New rows, and the slices of what has left, changed or gone.
    assert 0 < found.pairs <= (8 + 4 * 32) * 1.1 * n
    found = check(spark, window(changed, 20, n + 20, eps=0.07), changed, store, **options)
    assert found.pairs >= 0.9 * n * (n - 1) / 2
    found = check(spark, window(changed, 20, n + 20, least=5), changed, store, **options)
    assert found.pairs > 0
    # Of fewer neighbours, what was kept for more is enough.
    assert check(spark, window(changed, 20, n + 20, least=2), changed, store, **options).pairs == 0


def test_a_store_stays_small_and_whole(spark, tmp_path):
    vectors = cloud(11, 200)
    store, options = GraphStore(spark, str(tmp_path / "graph")), {"slice_rows": 8}
    for k in range(4):
        check(spark, window(vectors, 25 * k, 25 * k + 40), vectors, store, **options)
        assert len(store.runs()) <= 4
    # A run that did not get to its commit is written over.
    (tmp_path / "graph" / "members" / "run=3" / "_SUCCESS").unlink()
    check(spark, window(vectors, 100, 150), vectors, store, **options)
