"""Clustering against a sequential density clustering written here."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from newsburst.operators.components import connected_components
from newsburst.operators.dbscan import dbscan_labels, newest_per_key
from newsburst.session import stage

START = dt.datetime(2024, 1, 1)


def sequential(vectors, eps, min_samples):
    """Labels of the textbook algorithm over rows in the given order."""
    x = np.asarray(vectors, dtype=np.float64)
    norms = np.linalg.norm(x, axis=1)
    unit = x / np.where(norms == 0, 1, norms)[:, None]
    distance = 1 - unit @ unit.T
    same = (np.asarray(vectors)[:, None, :] == np.asarray(vectors)[None, :, :]).all(axis=2)
    distance[same & (norms > 0)[:, None]] = 0
    np.fill_diagonal(distance, 0)
    near = [np.flatnonzero(row <= eps) for row in distance]
    core = [len(n) >= min_samples for n in near]
    labels = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = number
        stack = [i]
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in near[j]:
                if labels[k] == -1:
                    labels[k] = number
                    stack.append(k)
        number += 1
    return labels.tolist(), core


def frames(spark, scopes, eps, min_samples, cap=80000):
    """Rows are given newest first; ids are shuffled so that they say nothing about order."""
    candidates, vectors, expected = [], [], {}
    next_id = 0
    for scope, rows in scopes.items():
        ids = np.random.default_rng(5).permutation(len(rows)) + next_id
        next_id += len(rows)
        labels, core = sequential(rows[:cap], eps, min_samples)
        for place, (row, row_id) in enumerate(zip(rows, ids)):
            time = START - dt.timedelta(minutes=place)
            candidates.append((scope, int(row_id), time, eps, min_samples, cap))
            vectors.append((int(row_id), [float(v) for v in row]))
            if place < cap:
                expected[(scope, int(row_id))] = (labels[place], core[place])
    return (
        spark.createDataFrame(
            candidates,
            "system_id BIGINT, id BIGINT, create_time TIMESTAMP_NTZ, eps DOUBLE, min_samples INT, cap BIGINT",
        ),
        spark.createDataFrame(vectors, "id BIGINT, embedding ARRAY<FLOAT>"),
        expected,
    )


def check(spark, scopes, eps, min_samples, cap=80000, **options):
    candidates, vectors, expected = frames(spark, scopes, eps, min_samples, cap)
    rows = dbscan_labels(candidates, vectors, ["system_id"], **options).collect()
    got = {(r["system_id"], r["id"]): (r["cluster_id"], r["is_core"]) for r in rows}
    assert got == expected


def blobs(seed, groups=6, size=25, dim=8, spread=0.25, noise=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = np.concatenate(
        [c + spread * rng.normal(size=(size, dim)) for c in centres] + [rng.normal(size=(noise, dim))]
    )
    return rng.permutation(rows).astype(np.float32)


@pytest.mark.parametrize(
    "options",
    [{}, {"block_rows": 16}, {"block_rows": 50, "task_edges": 0}],
    ids=["one block", "many blocks", "star rounds"],
)
def test_two_scopes(spark, options):
    check(spark, {1: blobs(1), 2: blobs(2, groups=3)}, 0.1, 4, **options)


def test_hot_group_of_copies(spark):
    rows = blobs(3, groups=4, size=15)
    copies = np.repeat(rows[:1], 60, axis=0)
    mixed = np.random.default_rng(0).permutation(np.concatenate([rows, copies]))
    check(spark, {1: mixed}, 0.05, 5, block_rows=20)


@pytest.mark.parametrize("eps,min_samples", [(0.3, 1), (0.3, 3), (1.0, 3)])
def test_zero_vectors(spark, eps, min_samples):
    rows = np.concatenate([blobs(4, groups=2, size=8, noise=2), np.zeros((3, 8), dtype=np.float32)])
    check(spark, {1: rows}, eps, min_samples)


def test_fewer_rows_than_min_samples_gives_noise(spark):
    check(spark, {1: np.ones((2, 4), dtype=np.float32)}, 0.5, 3)


def test_no_rows(spark):
    candidates, vectors, _ = frames(spark, {1: blobs(1)}, 0.1, 3)
    assert dbscan_labels(candidates.filter("id < 0"), vectors, ["system_id"]).count() == 0


def test_cap_keeps_the_newest(spark):
    check(spark, {1: blobs(6), 2: blobs(7, groups=1, size=10, noise=0)}, 0.1, 3, cap=70, block_rows=30)


def test_cap_within_one_minute(spark):
    """A bulk load: all rows share one minute, most share one instant; ids break ties."""
    rows = [(1, i, START if i % 4 else START + dt.timedelta(seconds=i % 50), 37) for i in range(300)]
    frame = spark.createDataFrame(rows, "system_id BIGINT, id BIGINT, create_time TIMESTAMP_NTZ, cap BIGINT")
    kept = {r["id"] for r in newest_per_key(stage(frame, "rows"), ["system_id"], salts=4).collect()}
    order = sorted(rows, key=lambda r: (-(r[2] - START).total_seconds(), r[1]))
    assert kept == {r[1] for r in order[:37]}


def test_border_row_joins_the_newer_cluster(spark):
    """One row lies within reach of a core row of two clusters, but is not core itself."""
    angle = lambda degrees: [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]
    left, right = [angle(a) for a in (0, 1, 2, 10)], [angle(a) for a in (38, 39, 40, 30)]
    rows = np.array(right + left + [angle(20)], dtype=np.float32)
    check(spark, {1: rows}, 1 - float(np.cos(np.radians(10.5))), 4)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), min_samples=st.integers(1, 6), block_rows=st.sampled_from([11, 40]))
def test_matches_sequential(spark, seed, min_samples, block_rows):
    check(spark, {1: blobs(seed, groups=4, size=12, noise=10)}, 0.12, min_samples, block_rows=block_rows)


@pytest.mark.parametrize("task_edges", [10, 0, 10_000])
def test_components_of_paths_and_a_hub(spark, task_edges):
    path = [(1, i, i + 1) for i in range(0, 40)]
    hub = [(1, 500, 1000 + i) for i in range(60)] + [(2, 7, 8), (2, 9, 8)]
    edges = stage(spark.createDataFrame(path + hub, "system_id BIGINT, a BIGINT, b BIGINT"), "edges")
    rows = connected_components(edges, ["system_id"], task_edges).collect()
    got = {(r["system_id"], r["id"]): r["root"] for r in rows}
    expected = {(1, i): 0 for i in range(41)}
    expected |= {(1, 500): 500} | {(1, 1000 + i): 500 for i in range(60)}
    expected |= {(2, i): 7 for i in (7, 8, 9)}
    assert got == expected


def test_strips_give_the_whole_tile(monkeypatch):
    """A task that compares in strips finds the degrees and components of the whole tile, and few blocks are made."""
    from newsburst.operators import neighbors as N

    for rows in (1_000, 100_000, 600_000):
        assert -(-rows // N.bounded_blocks(64, rows, 64)) <= N.MOST_BLOCKS
    assert N.bounded_blocks(64, 10**9, 1024) * 4 * 1024 <= N.BLOCK_BYTES
    monkeypatch.setattr(N, "STRIP_ROWS", 7)
    monkeypatch.setattr(N, "PENDING_EDGES", 20)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 4)).astype(np.float32)
    ids, mult = rng.permutation(60) + 100, rng.integers(1, 3, 60)
    near = lambda i, j: [N._adjacency(vectors[i], vectors[j], 0.2)]
    for p, q in ((np.arange(60), np.arange(60)), (np.arange(25), np.arange(25, 60))):
        diagonal = len(p) == 60
        whole = N.tile_parts(near(p, q)[0], ids[p], mult[p], ids[q], mult[q], diagonal, 4)
        (parts,), order = N.compare_strips(ids, mult, p, q, diagonal, near, 1, 4)
        assert (parts[0][1] == ids[order]).all()
        degree = {i: d for kind, a, b in whole if kind == N.DEGREE for i, d in zip(a, b)}
        assert dict(zip(parts[0][1], parts[0][2])) == degree

        def reached(parts):
            edges = [(a, b) for kind, x, y in parts if kind != N.DEGREE for a, b in zip(x, y) if min(degree[a], degree[b]) >= 4]
            return set(zip(*map(tuple, N.spanning_forest(*map(np.array, zip(*edges))))))

        assert reached(parts) == reached(whole)
        border = lambda parts: {frozenset(e) for kind, x, y in parts if kind == N.SPARSE for e in zip(x, y) if min(map(degree.get, e)) < 4}
        assert border(parts) == border(whole)


def test_rounds_deal_edges_into_tasks_of_bounded_size(spark, monkeypatch):
    """Rounds write their edges from as many tasks as their number asks for, with the components unchanged."""
    from newsburst.operators import components as K

    written = []
    monkeypatch.setattr(K, "PART_EDGES", 15)
    monkeypatch.setattr(K, "stage", lambda df, name: written.append(df) or stage(df, name))
    rows = [(1, 3 * i, 3 * i + k) for i in range(20) for k in (1, 2)]
    edges = stage(spark.createDataFrame(rows, "system_id long, a long, b long"), "e")
    found = connected_components(edges, ["system_id"], task_edges=0).collect()
    assert {(r.id, r.root) for r in found} == {(n, n - n % 3) for n in range(60)}
    assert all(df.rdd.getNumPartitions() == 3 for df in written[:1])


def test_a_scope_is_finished_by_strips_of_bounded_size(monkeypatch):
    from newsburst.operators import components

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000)
    a, b = np.r_[a, 1000, 7], np.r_[b, 1000, 7]  # a node with an edge to itself only
    expected = components._union(a, b)
    sizes, union = [], components._union
    monkeypatch.setattr(components, "_union", lambda a, b: sizes.append(len(a)) or union(a, b))
    monkeypatch.setattr(components, "PART_EDGES", 100)
    found = components._union_strips(*(pa.chunked_array([x[:2222], x[2222:]]) for x in (a, b)))
    assert [x.tolist() for x in found] == [x.tolist() for x in expected]
    assert max(sizes) <= 100 + 301
