"""Connected components of the contracted core graph, per scope."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.schemas import LONG, table
from newsburst.session import stage

# A scope whose edge list is at most this long (16 bytes an edge) is finished by one task.
TASK_EDGES = 4_000_000
# Edges that a task of a round takes, about.
PART_EDGES = 500_000


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node reachable from each node, by hooking and pointer jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return nodes, nodes[label]


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge from each node but the smallest of its component to that node."""
    nodes, roots = _union(a, b)
    useful = nodes != roots
    return nodes[useful], roots[useful]


def _union_strips(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``_union`` by strips of ``PART_EDGES`` edges, of which a spanning forest is carried on: what a task holds
    besides its edges grows with its nodes."""
    forest = np.empty(0, np.int64), np.empty(0, np.int64)
    lonely = []
    for start in range(0, len(a), PART_EDGES):
        strip = [side.slice(start, PART_EDGES).to_numpy() for side in (a, b)]
        loops = strip[0] == strip[1]
        lonely.append(strip[0][loops])
        forest = spanning_forest(*(np.concatenate([f, x[~loops]]) for f, x in zip(forest, strip)))
    loops = np.unique(np.concatenate([np.empty(0, np.int64), *lonely]))
    return _union(*(np.concatenate([side, loops]) for side in forest))


def _schema(edges: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([edges.schema[k] for k in keys] + table(id=LONG, root=LONG).fields)


def finish_in_tasks(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Components with one task per scope; the caller has checked the scopes' sizes."""

    def finish(table: pa.Table) -> pa.Table:
        nodes, roots = _union_strips(table.column("a"), table.column("b"))
        columns = [pa.repeat(table.column(k)[0], len(nodes)) for k in keys]
        return pa.Table.from_arrays(
            [*columns, pa.array(nodes), pa.array(roots)], names=[*keys, "id", "root"]
        )

    return edges.select(*keys, "a", "b").groupBy(*keys).applyInArrow(finish, _schema(edges, keys))


def _hook(edges: DataFrame, keys: list[str], small: bool, parts: int) -> DataFrame:
    """One half round of star contraction: every node sends its smallest neighbour (or
    itself) to its larger neighbours, or to its smaller ones.

    Edges are dealt by their first node into ``parts``, so that minimum and join share one shuffle of tasks of
    bounded size; the join streams the edges of a node with very many neighbours from its sort.
    """
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.filter(F.col("b") < F.col("a"))
    both = both.repartition(parts, *keys, "a")
    least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, [*keys, "a"])
    if small:
        moved = joined.select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select(*keys, "a", F.col("m").alias("b"))
        result = moved.unionByName(own)
    else:
        result = joined.filter(F.col("b") > F.col("a")).select(
            *keys, F.col("b").alias("a"), F.col("m").alias("b")
        )
    return result.filter(F.col("a") != F.col("b")).repartition(parts, *keys, "a", "b").distinct()


def _is_star(edges: DataFrame, keys: list[str], parts: int) -> bool:
    """Whether no node has two parents, or a parent and children."""
    ends = edges.select(*keys, F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(*keys, F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    met = ends.repartition(parts, *keys, "n").groupBy(*keys, "n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0


def _star_rounds(edges: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Alternate the two half rounds until every component is a star around its smallest
    node. Each round is written to the shared folder, which cuts the lineage. Rounds take no more edges than
    the ``rows`` there are at first, which give the number of tasks."""
    parts = max(1, math.ceil(rows / PART_EDGES))
    edges = stage(
        edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .repartition(parts, *keys, "a", "b")
        .distinct(),
        "edges",
    )
    while not _is_star(edges, keys, parts):
        hooked = _hook(edges, keys, small=False, parts=parts)
        edges = stage(_hook(hooked, keys, small=True, parts=parts), "edges")
    roots = edges.select(*keys, F.col("b").alias("id"), F.col("b").alias("root"))
    roots = roots.repartition(parts, *keys, "id").distinct()
    return edges.select(*keys, F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def connected_components(
    edges: DataFrame, keys: list[str], task_edges: int = TASK_EDGES
) -> DataFrame:
    """(keys, id, root) for every node of ``edges`` (keys, a, b); root = smallest id.

    ``edges`` should be staged: it is read more than once.
    """
    sizes = edges.groupBy(*keys).agg(F.count("*").alias("_n"))
    largest, rows = (n or 0 for n in sizes.agg(F.max("_n"), F.sum("_n")).first())
    if largest <= task_edges:
        return finish_in_tasks(edges, keys)
    big = sizes.filter(F.col("_n") > task_edges).select(*keys)
    rest = edges.join(big, keys, "left_anti")
    hard = edges.join(big, keys, "left_semi")
    return finish_in_tasks(rest, keys).unionByName(_star_rounds(hard, keys, rows))
