"""Exact DBSCAN on cosine distance for many scopes in one job."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.functions.scalars import age_micros
from newsburst.operators.components import TASK_EDGES, connected_components, finish_in_tasks
from newsburst.operators.neighbors import (
    BLOCK_ROWS,
    DEGREE,
    FOREST,
    SPARSE,
    assign_blocks,
    bounded_blocks,
    choose_pivots,
    chunk_blocks,
    neighbour_summary,
    pack_vectors,
    tile_list,
)
from newsburst.schemas import FLAG, LONG, table
from newsburst.session import stage

NOISE = -1
# Stands for a null cap.
NO_CAP = 1 << 62
# Narrow per-row tables (some tens of bytes a row) of at most this many rows are broadcast.
BROADCAST_ROWS = 100_000


def newest_per_key(rows: DataFrame, keys: list[str], cap: str = "cap", salts: int = 32) -> DataFrame:
    """The ``cap`` newest rows of each key (ties by id), without sorting whole keys; a key with
    a null cap keeps all its rows.

    A count per minute finds the minute in which the cap is reached. Newer minutes are kept
    as they are; only rows of that one minute are ranked, first within salted shares and
    then among the survivors, so neither a hot key nor a bulk load in one minute lands in
    one task. ``rows`` should be staged: it is read three times.
    """
    minute = F.date_trunc("minute", F.col("create_time"))
    counted = rows.withColumn("_minute", minute)
    per_minute = counted.groupBy(*keys, "_minute").agg(
        F.count("*").alias("_n"), F.coalesce(F.max(cap), F.lit(NO_CAP)).alias("_cap")
    )
    newest = Window.partitionBy(*keys).orderBy(F.col("_minute").desc())
    edges = (
        per_minute.withColumn("_upto", F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_room", F.col("_cap") - (F.col("_upto") - F.col("_n")))
        .filter(F.col("_room") > 0)
        .select(*keys, "_minute", "_room", (F.col("_upto") <= F.col("_cap")).alias("_whole"))
    )
    whole = counted.join(edges.filter("_whole"), [*keys, "_minute"], "left_semi").select(rows.columns)
    order = [F.col("create_time").desc(), F.col("id").asc()]
    cut = counted.join(edges.filter("NOT _whole"), [*keys, "_minute"])
    share = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = (
        cut.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(share))
        .filter(F.col("_rank") <= F.col("_room"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("_rank") <= F.col("_room"))
        .select(rows.columns)
    )
    return whole.unionByName(cut)


def recency_numbers(rows: DataFrame, keys: list[str], name: str = "rn") -> DataFrame:
    """``rows`` with their place in each key, newest first and ties by id, counted from 1.

    Rows are dealt into ranges of (key, time, id), so a hot key or a bulk load with one time takes as many
    tasks as it fills; a row's number is its place in its range plus the rows of its key in earlier ranges. Rows with
    equal key, time and id are numbered in any order. A null in ``keys`` is a key of its own.
    """
    order = [F.col("create_time").desc(), F.col("id").asc()]
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return inside.join(starts, same).select(*rows.columns, (F.col("_start") + F.col("_place")).alias(name))


def _scope_sizes(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.count("*").alias("scope_rows"), F.max("cap").alias("_cap"))


def _graph(summary: DataFrame, keys: list[str], small) -> DataFrame:
    """Core points, edges between them, and edges from border points to them.

    Rows (keys, role, a, b, found); only core rows carry ``found``, their place in the
    newest-first order.
    """
    core = (
        summary.filter(F.col("kind") == DEGREE)
        .groupBy(*keys, F.col("a").alias("rep"))
        .agg(
            F.sum("b").alias("degree"),
            F.max("age").alias("age"),
            F.max("first_id").alias("id"),
            F.max("min_samples").alias("min_samples"),
        )
        .filter(F.col("degree") >= F.col("min_samples"))
        .select(*keys, "rep", F.struct("age", "id").alias("found"))
    )

    def flag(side):
        return small(core.select(*keys, F.col("rep").alias(side), F.lit(True).alias(f"{side}_core")))

    sparse = (
        summary.filter(F.col("kind") == SPARSE)
        .join(flag("a"), [*keys, "a"], "left")
        .join(flag("b"), [*keys, "b"], "left")
        .filter(F.col("a_core") | F.col("b_core"))
    )
    swap = F.col("a_core").isNull()
    unseen = F.lit(None).cast(core.schema["found"].dataType).alias("found")
    sparse_edges = sparse.select(
        *keys,
        F.when(F.col("a_core") & F.col("b_core"), "edge").otherwise("border").alias("role"),
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        unseen,
    )
    forest = summary.filter(F.col("kind") == FOREST).select(
        *keys, F.lit("edge").alias("role"), "a", "b", unseen
    )
    cores = core.select(
        *keys, F.lit("core").alias("role"), F.col("rep").alias("a"), F.col("rep").alias("b"), "found"
    )
    return cores.unionByName(forest).unionByName(sparse_edges)


@dataclass(frozen=True)
class Neighbourhood:
    """What the comparison of vectors found, staged, with the sizes observed on the way."""

    candidates: DataFrame  # after the cap
    members: DataFrame  # candidates with the digest of their vector
    copies: DataFrame  # one row per scope and distinct vector, named by its smallest id (rep)
    summary: DataFrame  # degrees, forest and sparse edges between reps
    rows: int
    edges: int
    degrees: int
    one_block: bool


def staged_candidates(candidates: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The candidates, written, with their number and the smallest cap."""
    seen = Observation()
    candidates = stage(
        candidates.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.min("cap"), F.lit(NO_CAP)).alias("cap")
        ),
        "candidates",
    )
    return candidates, (seen.get["rows"], seen.get["cap"])


def _compared(
    candidates: DataFrame, vectors: DataFrame, keys: list[str], block_rows: int, counted: tuple[int, int] | None = None
) -> Neighbourhood | None:
    """Compare the vectors of every scope in blocks; nothing when there are no candidates."""
    time_type = candidates.schema["create_time"].dataType
    if counted is None:
        candidates, counted = staged_candidates(candidates)
    rows, cap = counted
    if not rows:
        return None
    # Every table below has at most one row per candidate, so the observed count bounds it.
    small = F.broadcast if rows <= BROADCAST_ROWS else (lambda df: df)
    blocks = 1
    if rows > min(block_rows, cap):
        largest, over = (
            _scope_sizes(candidates, keys)
            .agg(F.max("scope_rows"), F.max(F.col("scope_rows") > F.col("_cap")))
            .first()
        )
        if over:
            candidates = stage(newest_per_key(candidates, keys), "newest")
            largest = _scope_sizes(candidates, keys).agg(F.max("scope_rows")).first()[0]
        blocks = math.ceil(largest / block_rows)

    # Vectors are packed once per article, however many scopes see it.
    vectors = vectors.join(candidates.select("id").distinct(), "id", "left_semi")
    pivots = choose_pivots(vectors, blocks) if blocks > 1 else None
    packed = stage(pack_vectors(vectors, pivots), "vectors")

    # Equal vectors of a scope become one weighted point before any vector is shuffled.
    members = candidates.join(small(packed.select("id", "digest")), "id")
    aged = members.withColumn("age", age_micros(F.col("create_time"), time_type))
    copies = aged.groupBy(*keys, "digest").agg(
        F.min("id").alias("rep"),
        F.count("*").alias("mult"),
        F.min(F.struct("age", "id")).alias("first"),
        F.max("eps").alias("eps"),
        F.max("min_samples").alias("min_samples"),
    )
    points = copies.select(
        *keys,
        F.col("rep").alias("id"),
        "mult",
        F.col("first.age").alias("age"),
        F.col("first.id").alias("first_id"),
        "eps",
        "min_samples",
    ).join(packed.select("id", "vec", "cells", "angles"), "id")
    if pivots is None:
        tiles, tile_count = None, math.ceil(rows / 1024)
    else:
        block_rows = bounded_blocks(block_rows, largest, pivots.shape[1])
        levels = int(math.log2(len(pivots))) + 1
        points = points.join(_scope_sizes(candidates, keys).drop("_cap"), keys)
        points = assign_blocks(points, keys, block_rows, levels)
        points = stage(chunk_blocks(points, keys), "blocks")
        tiles = stage(tile_list(points, keys, pivots), "tiles")
        tile_count = tiles.count()
    counted = Observation()
    summary = stage(
        neighbour_summary(points, tiles, keys, tile_count).observe(
            counted,
            F.count_if(F.col("kind") != DEGREE).alias("edges"),
            F.count_if(F.col("kind") == DEGREE).alias("degrees"),
        ),
        "summary",
    )
    found = counted.get
    return Neighbourhood(
        candidates, members, copies, summary, rows, found["edges"], found["degrees"], pivots is None
    )


def neighbour_counts(
    candidates: DataFrame, vectors: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(keys, id, neighbours): how many rows of its scope lie within eps of each, itself included."""
    found = _compared(candidates, vectors, keys, block_rows)
    if found is None:
        return candidates.select(*keys, "id", F.lit(0).cast("long").alias("neighbours")).limit(0)
    degrees = (
        found.summary.filter(F.col("kind") == DEGREE)
        .groupBy(*keys, F.col("a").alias("rep"))
        .agg(F.sum("b").alias("neighbours"))
    )
    named = found.members.join(found.copies.select(*keys, "digest", "rep"), [*keys, "digest"])
    return named.join(degrees, [*keys, "rep"]).select(*keys, "id", "neighbours")


def dbscan_labels(
    candidates: DataFrame,
    vectors: DataFrame,
    keys: list[str],
    block_rows: int = BLOCK_ROWS,
    task_edges: int = TASK_EDGES,
    counted: tuple[int, int] | None = None,
) -> DataFrame:
    """Cluster every scope of ``candidates`` and label each of its rows.

    candidates: keys, id, create_time, eps, min_samples, cap (the last three constant per
    scope, cap may be null); vectors: id, embedding. Returns keys, id, create_time, is_core, cluster_id with
    -1 for noise. Clusters are numbered by their newest core row; a border row belongs to
    the lowest-numbered cluster it touches.

    Sizes are observed while a table is written, or ``counted`` where the candidates are staged. When all rows together fit one block, and
    all edges together one task, the jobs that would size each scope are left out.
    """
    compared = _compared(candidates, vectors, keys, block_rows, counted)
    if compared is None:
        return no_labels(candidates, keys)
    candidates, members, copies = compared.candidates, compared.members, compared.copies
    # A single block holds each distinct vector once: as many points as rows means no copies.
    if compared.one_block and compared.degrees == compared.rows:
        named = candidates.withColumn("rep", F.col("id"))
    else:
        named = members.join(copies.select(*keys, "digest", "rep"), [*keys, "digest"])
    return label_rows(named, compared.summary, keys, compared.rows, compared.edges, task_edges)


def no_labels(candidates: DataFrame, keys: list[str]) -> DataFrame:
    time_type = candidates.schema["create_time"].dataType
    result_schema = T.StructType(
        [candidates.schema[k] for k in keys]
        + table(id=LONG, create_time=time_type, is_core=FLAG, cluster_id=LONG).fields
    )
    return candidates.sparkSession.createDataFrame([], result_schema)


def label_rows(
    named: DataFrame, summary: DataFrame, keys: list[str], rows: int, edges: int, task_edges: int = TASK_EDGES
) -> DataFrame:
    """Labels of ``named`` (keys, id, create_time, rep) from a staged neighbour summary between reps;
    ``rows`` and ``edges`` bound the rows of both tables."""
    small = F.broadcast if rows <= BROADCAST_ROWS else (lambda df: df)
    graph = _graph(summary, keys, small)
    few = edges <= task_edges
    if not few:
        graph = stage(graph, "graph")
    links = graph.filter(F.col("role") == "edge").select(*keys, "a", "b")
    roots = finish_in_tasks(links, keys) if few else connected_components(links, keys, task_edges)

    # Number the components of a scope by their newest core row.
    cores = (
        graph.filter(F.col("role") == "core")
        .select(*keys, F.col("a").alias("id"), "found")
        .join(small(roots), [*keys, "id"], "left")
        .select(*keys, "id", F.coalesce("root", "id").alias("root"), "found")
    )
    numbered = (
        cores.groupBy(*keys, "root")
        .agg(F.min("found").alias("found"))
        .withColumn(
            "cluster_id",
            (F.dense_rank().over(Window.partitionBy(*keys).orderBy("found")) - 1).cast("long"),
        )
        .select(*keys, "root", "cluster_id")
    )
    core_labels = cores.join(small(numbered), [*keys, "root"]).select(*keys, "id", "cluster_id")
    border_labels = (
        graph.filter(F.col("role") == "border")
        .join(small(core_labels.withColumnRenamed("id", "a")), [*keys, "a"])
        .groupBy(*keys, F.col("b").alias("id"))
        .agg(F.min("cluster_id").alias("cluster_id"))
    )
    labels = core_labels.select("*", F.lit(True).alias("is_core")).unionByName(
        border_labels.select("*", F.lit(False).alias("is_core"))
    )
    labels = small(labels.withColumnRenamed("id", "rep"))
    labelled = named.join(labels, [*keys, "rep"], "left").select(
        *keys,
        "id",
        "create_time",
        F.coalesce("is_core", F.lit(False)).alias("is_core"),
        F.coalesce("cluster_id", F.lit(NOISE).cast("long")).alias("cluster_id"),
    )
    return stage(labelled, "labels")
