"""Density clustering of many scopes over common rows, each pair of vectors compared once.

Tenants see a common pool, presets one article table through windows of their own, the ticks of a
backfill windows that overlap, a refresh almost the rows of the one before. Scope by scope, the
same vectors would be compared again and again. Here

1. rows are put into groups: all rows of a group are in the same scopes;
2. each pair of groups that some scope holds together is compared once, block by block, at all
   the distances that its scopes ask for, for the largest of their ``min_samples``. What a tile
   keeps (degrees, a forest of dense points, the edges of the others) is exact at any
   ``min_samples`` up to that one, since a point that is dense at the larger is dense at the smaller;
3. a scope's graph is what was kept of its pairs of groups, at its own distance. Degrees are summed,
   components and numbers follow as for a single scope, without the vectors.

With a ``GraphStore`` groups, blocks and tiles stay for the next run, in slices of time: a later run compares only
pairs of groups that are new. A slice of which some row has left its scopes, has changed its vector
or has been joined to another scope is grouped anew; everything else stands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.functions.scalars import age_micros
from newsburst.operators.components import TASK_EDGES
from newsburst.operators.dbscan import (
    BROADCAST_ROWS,
    dbscan_labels,
    label_rows,
    newest_per_key,
    no_labels,
    staged_candidates,
)
from newsburst.operators.neighbors import (
    BLOCK_BYTES,
    BLOCK_ROWS,
    DEGREE,
    MOST_BLOCKS,
    _matrix,
    assign_blocks,
    bounded_blocks,
    choose_pivots,
    chunk_blocks,
    compare_strips,
    distance_levels,
    pack_vectors,
)
from newsburst.schemas import INT, LONG, TEXT, table
from newsburst.session import file_system, scratch_path, single_threaded_blas, stage

#: Rows of a time slice of a stored graph, about; fewer would make many small tiles.
SLICE_ROWS = 512
#: Points of a panel at most, of whose blocks a task compares all tiles with those of another.
PANEL_ROWS = 32_768
#: Panels are not cut below this many points for the sake of more tasks.
SMALL_PANEL = 1024
MOST_SLICES = 128

MEMBERS = table(grp=TEXT, share=LONG, id=LONG, rep=LONG, mark=LONG, born=LONG)
BLOCKS = table(
    grp=TEXT, cell=INT, part=INT, eps=T.DoubleType(), min_samples=INT, angle=T.FloatType(), id=T.ArrayType(LONG),
    mult=T.ArrayType(LONG), age=T.ArrayType(LONG), first_id=T.ArrayType(LONG), vec=T.BinaryType(),
)
SUMMARY = table(
    pg=TEXT, qg=TEXT, level=T.DoubleType(), run=LONG, kind=T.ByteType(), a=LONG, b=LONG, age=LONG, first_id=LONG,
)
DONE = table(pg=TEXT, qg=TEXT, level=T.DoubleType(), most=INT, run=LONG, pairs=LONG)
PIVOTS = table(place=INT, embedding=T.ArrayType(T.FloatType()))


class GraphStore:
    """Groups, blocks and tiles of earlier runs in a folder of shared storage.

    A run writes its parts under its own number, the members last: these are its commit. Parts of a run
    that did not get so far are written over by the next. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def runs(self) -> list[int]:
        system, path = file_system(self.spark, f"{self.path}/members/run=*/_SUCCESS")
        found = system.globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def write(self, rows: DataFrame, name: str, run: int) -> DataFrame:
        path = f"{self.path}/{name}/run={run}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(self, name: str, schema: T.StructType, runs: list[int]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{name}/run={n}" for n in runs]
        return self.spark.read.schema(schema).parquet(*paths)

    def keep(self, runs: list[int]) -> None:
        """Removes the parts of all other runs."""
        for name in ("members", "blocks", "summary", "done", "pivots"):
            system, path = file_system(self.spark, f"{self.path}/{name}/run=*")
            for found in system.globStatus(path) or []:
                if int(found.getPath().getName().split("=")[1]) not in runs:
                    system.delete(found.getPath(), True)


@dataclass(frozen=True)
class Compared:
    """Labels, and what a run compared: pairs of distinct vectors, of tiles and of groups."""

    labels: DataFrame
    pairs: int
    tiles: int
    groups: int


def _small(rows: int):
    return F.broadcast if rows <= BROADCAST_ROWS else (lambda df: df)


def _patterns(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(share, id, kind, create_time): rows of one kind are in the same scopes, with equal parameters.

    The set of a row's scopes is named by digests that do not hang on their order, so they are
    aggregated before any shuffle and no list of scopes is gathered.
    """
    scope = [*keys, "eps", "min_samples"]
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), *scope)).alias(f"_{salt}") for salt in (1, 2)]
    found = candidates.groupBy("share", "id").agg(*marks, F.count("*").alias("_n"), F.min("create_time").alias("create_time"))
    kind = F.concat_ws(":", F.coalesce(F.col("share").cast("string"), F.lit("all")), "_1", "_2", "_n")
    return found.select("share", "id", kind.alias("kind"), "create_time")


def _slices(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Adds ``slice``: a number of the row's time, by widths that are powers of two in minutes and give each
    share about ``slice_rows`` rows a slice, so that slices are the same ones from run to run."""
    minute = F.floor(F.unix_micros(F.col("create_time").cast("timestamp")) / F.lit(60_000_000))
    rows = rows.withColumn("_minute", minute)
    span = F.max("_minute") - F.min("_minute") + 1
    parts = F.least(F.greatest(F.floor(F.count("*") / F.lit(slice_rows)), F.lit(1)), F.lit(MOST_SLICES))
    bits = F.ceil(F.log2(F.greatest(span / parts, F.lit(1.0)))).cast("int")
    widths = rows.groupBy("share").agg(bits.alias("_bits"))
    joined = rows.join(widths.withColumnRenamed("share", "_share"), F.col("share").eqNullSafe(F.col("_share")))
    return joined.withColumn(
        "slice", F.concat_ws("/", F.col("_bits").cast("string"), F.floor(F.col("_minute") / F.pow(F.lit(2.0), "_bits")).cast("string"))
    ).drop("_minute", "_bits", "_share")


def _standing(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(share, id, grp) of the rows of stored groups that are whole: all their rows are still there, with
    their vectors, and in one set of scopes."""
    found = stored.select(F.col("share").alias("_share"), F.col("id").alias("_id"), "grp", F.col("mark").alias("_mark"))
    met = found.join(
        rows, F.col("share").eqNullSafe(F.col("_share")) & (F.col("id") == F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark")), "left"
    )
    groups = met.groupBy("grp").agg(
        F.count("*").alias("_all"), F.count("kind").alias("_there"), F.min("kind").alias("_low"), F.max("kind").alias("_high")
    )
    whole = groups.filter((F.col("_all") == F.col("_there")) & (F.col("_low") == F.col("_high"))).select("grp")
    return met.join(whole, "grp", "left_semi").select(F.col("_share").alias("share"), F.col("_id").alias("id"), "grp")


def _points(members: DataFrame, packed: DataFrame, time_type, small) -> tuple[DataFrame, DataFrame]:
    """(grp, share, id, rep) and one weighted point per group and distinct vector."""
    met = members.join(small(packed.select("id", "digest")), "id")
    aged = met.withColumn("_age", age_micros(F.col("create_time"), time_type))
    copies = aged.groupBy("grp", "digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("mult"), F.min(F.struct("_age", "id")).alias("first")
    )
    named = met.join(copies.select("grp", "digest", "rep"), ["grp", "digest"]).select("grp", "share", "id", "rep", "mark")
    points = copies.select(
        "grp", F.col("rep").alias("id"), "mult", F.col("first._age").alias("age"), F.col("first.id").alias("first_id"),
        F.lit(0.0).alias("eps"), F.lit(0).alias("min_samples"),
    )
    return named, points.join(packed.select("id", "vec", "cells", "angles"), "id")


def _blocks(points: DataFrame, pivots: np.ndarray | None, block_rows: int) -> DataFrame:
    sizes = points.groupBy("grp").agg(F.count("*").alias("scope_rows"))
    levels = 1 if pivots is None else int(math.log2(len(pivots))) + 1
    dealt = assign_blocks(points.join(sizes, "grp"), ["grp"], block_rows, levels)
    return chunk_blocks(dealt, ["grp"]).select(*BLOCKS.names)


def _tiles(blocks: DataFrame, todo: DataFrame, pivots: np.ndarray | None) -> DataFrame:
    """(pg, pc, pp, qg, qc, qp, levels, most, pairs): pairs of blocks of the pairs of groups to do that may hold
    neighbours, by the balls that the blocks lie in."""
    held = blocks.groupBy("grp", "cell", "part").agg(
        F.max("angle").alias("radius"), F.sum(F.size("id")).alias("held")
    )
    p, q = (held.select(*[F.col(c).alias(f"{side}{c[0]}") for c in ("grp", "cell", "part", "radius", "held")]) for side in "pq")
    pairs = todo.groupBy("pg", "qg").agg(F.sort_array(F.collect_set("level")).alias("levels"), F.max("most").alias("most"))
    pairs = pairs.join(p, "pg").join(q, "qg")
    same = F.col("pg") == F.col("qg")
    ordered = (F.col("pc") < F.col("qc")) | ((F.col("pc") == F.col("qc")) & (F.col("pp") <= F.col("qp")))
    pairs = pairs.filter(~same | ordered)
    if pivots is not None and len(pivots) > 1:
        between = np.arccos(np.clip(pivots.astype(np.float64) @ pivots.T.astype(np.float64), -1, 1))
        np.fill_diagonal(between, 0.0)
        rows = [(i, j, float(between[i, j])) for i in range(len(pivots)) for j in range(len(pivots))]
        gaps = blocks.sparkSession.createDataFrame(rows, "pc INT, qc INT, gap DOUBLE")
        widest = F.lit(1.0) - F.array_max("levels")
        reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), widest)))
        near = F.col("gap") - F.col("pr") - F.col("qr") <= reach + F.lit(2e-3)
        pairs = pairs.join(F.broadcast(gaps), ["pc", "qc"]).filter(near)
    diagonal = same & (F.col("pc") == F.col("qc")) & (F.col("pp") == F.col("qp"))
    count = F.when(diagonal, F.col("ph") * (F.col("ph") - 1) / 2).otherwise(F.col("ph") * F.col("qh")).cast("long")
    return pairs.select("pg", "pc", "pp", "qg", "qc", "qp", "levels", "most", diagonal.alias("diagonal"), count.alias("pairs"))


def _panelled(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """``tiles`` with ``lo`` and ``hi``: the panels of their blocks. A panel is a run of blocks with alike numbers of
    points, so that blocks are copied as often as there are panels, however many groups they are compared with."""
    own = ["grp", "cell", "part"]
    width = F.length("vec") / F.greatest(F.size("id"), F.lit(1))
    held = blocks.groupBy(*own).agg(F.sum(F.size("id")).alias("_held"), F.max(width).alias("_width"))
    # One row per block.
    total, widest = F.sum("_held").over(Window.partitionBy()), F.max("_width").over(Window.partitionBy())
    upto = F.sum("_held").over(Window.orderBy(*own))
    some = F.least(F.lit(MOST_BLOCKS), F.ceil(total / F.lit(SMALL_PANEL)))
    most = F.greatest(some, F.ceil(total / F.lit(PANEL_ROWS)), F.ceil(total * widest / F.lit(BLOCK_BYTES)))
    panels = held.select(*own, F.floor((upto - F.col("_held")) * most / total).cast("int").alias("panel"))
    for side in "pq":
        named = panels.select(*[F.col(c).alias(f"{side}{c[0]}") for c in own], F.col("panel").alias(f"_{side}"))
        tiles = tiles.join(named, [f"{side}{c[0]}" for c in own])
    return tiles.withColumns({"lo": F.least("_p", "_q"), "hi": F.greatest("_p", "_q")}).drop("_p", "_q")


def _compare(blocks: DataFrame, tiles: DataFrame, run: int) -> DataFrame:
    """The summary of all tiles, level by level: as in ``neighbors``, degrees, forest and sparse edges. One task
    compares all tiles of a pair of panels."""
    panelled = stage(_panelled(blocks, tiles), "panelled")
    task, own = ["lo", "hi"], ["grp", "cell", "part"]
    as_p, as_q = (panelled.select(*task, *[F.col(f"{side}{c[0]}").alias(c) for c in own]) for side in "pq")
    held = blocks.join(as_p.unionByName(as_q).distinct(), own).select(*task, *own, "id", "mult", "age", "first_id", "vec")

    def compare(block: pa.Table, todo: pa.Table) -> pa.Table:
        sizes = np.asarray(block.column("id").combine_chunks().value_lengths())
        ids, mult, age, first_id = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("id", "mult", "age", "first_id"))
        vectors = _matrix(block.column("vec"), len(ids))
        places: dict[tuple, list[np.ndarray]] = {}
        ends = np.cumsum(sizes)
        for name, end, size in zip(zip(*(block.column(c).to_pylist() for c in own)), ends, sizes):
            places.setdefault(name, []).append(np.arange(end - size, end))
        out = [pa.Table.from_batches([], schema=found_schema)]
        for tile in todo.to_pylist():
            p, q = (np.concatenate(places[tile[f"{side}g"], tile[f"{side}c"], tile[f"{side}p"]]) for side in "pq")
            both = p if tile["diagonal"] else np.r_[p, q]
            levels = np.array(tile["levels"])
            at = np.arange(len(both))
            first, second = at[: len(p)], at if tile["diagonal"] else at[len(p) :]

            def near(i, j):
                place = distance_levels(vectors[both[i]], vectors[both[j]], levels)
                return (place <= k for k in range(len(levels)))

            found, order = compare_strips(ids[both], mult[both], first, second, tile["diagonal"], near, len(levels), tile["most"])
            order = both[order]
            for level, parts in zip(levels.tolist(), found):
                kind = np.concatenate([np.full(len(a), kind, np.int8) for kind, a, _ in parts])
                rest = pa.nulls(len(kind) - len(order), pa.int64())
                columns = [pa.repeat(pa.scalar(tile[c]), len(kind)) for c in ("pg", "qg")]
                columns += [pa.repeat(pa.scalar(level), len(kind)), pa.repeat(pa.scalar(run, pa.int64()), len(kind)), pa.array(kind)]
                columns += [pa.array(np.concatenate([np.asarray(part[s], np.int64) for part in parts])) for s in (1, 2)]
                columns += [pa.concat_arrays([pa.array(values[order]), rest]) for values in (age, first_id)]
                # A point without neighbours in a tile adds nothing.
                useful = pa.array((columns[4].to_numpy() != DEGREE) | (columns[6].to_numpy() > 0))
                out.append(pa.Table.from_arrays(columns, names=SUMMARY.names).filter(useful))
        return pa.concat_tables(out)

    long = pa.int64()
    found_schema = pa.schema(list(zip(SUMMARY.names, (pa.string(), pa.string(), pa.float64(), long, pa.int8(), long, long, long, long))))
    single_threaded_blas(blocks.sparkSession)
    partitions = max(1, min(2 * panelled.select(*task).distinct().count(), 20_000))
    todo = panelled.select(
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "pg", "pc", "pp", "qg", "qc", "qp", "levels", "most", "diagonal"
    )
    held = held.repartition(partitions, *task).groupBy(*task)
    return held.cogroup(todo.repartition(partitions, "_lo", "_hi").groupBy("_lo", "_hi")).applyInArrow(compare, SUMMARY)


def shared_labels(
    candidates: DataFrame, vectors: DataFrame, keys: list[str], store: GraphStore | None = None,
    block_rows: int = BLOCK_ROWS, task_edges: int = TASK_EDGES, slice_rows: int = SLICE_ROWS,
    counted: tuple[int, int] | None = None,
) -> Compared:
    """``dbscan_labels`` for scopes that have rows in common.

    candidates: keys, id, create_time, eps, min_samples, cap, and share: null where an id's rows in several
    scopes are to be compared as one, else a number that keeps them to the scopes that give the same.
    """
    spark = candidates.sparkSession
    time_type = candidates.schema["create_time"].dataType
    if counted is None:
        candidates, counted = staged_candidates(candidates)
    rows, cap = counted
    runs = store.runs() if store else []
    run = runs[-1] + 1 if runs else 0
    if not rows:
        return Compared(no_labels(candidates, keys), 0, 0, 0)
    small = _small(rows)
    if rows > cap:
        candidates = stage(newest_per_key(candidates, keys), "newest")
    own = _patterns(candidates, keys)
    if store is None:
        grouped = own.withColumn("mark", F.lit(None).cast("long"))
        members = stage(grouped.select(F.col("kind").alias("grp"), "share", "id", "mark", "create_time"), "members")
        standing = spark.createDataFrame([], MEMBERS)
        fresh = members
    else:
        marks = vectors.select("id", F.xxhash64("embedding").alias("mark"))
        own = stage(own.join(marks, "id"), "own")
        stored = store.read("members", MEMBERS, runs[-1:])
        kept = _standing(own, stored)
        standing = stage(stored.join(kept.select("grp").distinct(), "grp", "left_semi"), "standing")
        known = standing.select(F.col("share").alias("_share"), F.col("id").alias("_id"))
        fresh = own.join(known, F.col("share").eqNullSafe(F.col("_share")) & (F.col("id") == F.col("_id")), "left_anti")
        grp = F.concat_ws(":", "kind", "slice", F.lit(str(run)))
        fresh = stage(_slices(fresh, slice_rows).select(grp.alias("grp"), "share", "id", "mark", "create_time"), "fresh")

    # Vectors are packed for new rows only, once per article.
    wanted = vectors.join(fresh.select("id").distinct(), "id", "left_semi")
    if runs:
        given = [r.embedding for r in store.read("pivots", PIVOTS, runs[:1]).orderBy("place").collect()]
        pivots = np.array(given, np.float32) if given else None
    else:
        blocks_wanted = math.ceil(rows / block_rows)
        pivots = choose_pivots(wanted, blocks_wanted) if blocks_wanted > 1 else None
    packed = stage(pack_vectors(wanted, pivots), "vectors")
    named, points = _points(fresh, packed, time_type, small)
    named = stage(named.withColumn("born", F.lit(run).cast("long")).select(*MEMBERS.names), "named")
    if pivots is not None:
        block_rows = bounded_blocks(block_rows, named.count(), pivots.shape[1])
    blocks = _blocks(points, pivots, block_rows)
    everyone = standing.unionByName(named)
    if store is None:
        blocks = stage(blocks, "blocks")
        done = spark.createDataFrame([], DONE)
    else:
        live = everyone.select("grp", "born").distinct()
        born = sorted(r.born for r in standing.select("born").distinct().collect())
        new_blocks = store.write(blocks, "blocks", run)
        blocks = store.read("blocks", BLOCKS, born).join(live.select("grp"), "grp", "left_semi").unionByName(new_blocks)
        done = store.read("done", DONE, runs[-1:])

    # Which groups each scope has, and which pairs of them are not compared yet.
    met = everyone.select(F.col("share").alias("_share"), F.col("id").alias("_id"), "grp", "rep")
    placed = candidates.join(met, F.col("share").eqNullSafe(F.col("_share")) & (F.col("id") == F.col("_id")))
    placed = stage(placed.select(*keys, "id", "create_time", "grp", "rep", "eps", "min_samples"), "placed")
    alive = stage(placed.select(*keys, "grp", "eps", "min_samples").distinct(), "alive")
    p = alive.withColumnRenamed("grp", "pg")
    q = alive.select(*keys, F.col("grp").alias("qg"))
    together = stage(p.join(q, keys).filter("pg <= qg"), "together")
    needed = together.groupBy("pg", "qg", F.col("eps").alias("level")).agg(F.max("min_samples").alias("most"))
    had = done.select("pg", "qg", "level", F.col("most").alias("_most"))
    todo = needed.join(had, ["pg", "qg", "level"], "left").filter("_most is null or _most < most").drop("_most")
    todo = stage(todo, "todo")
    tiles = stage(_tiles(blocks, todo, pivots), "tiles")
    tile_count, pairs = tiles.agg(F.count("*"), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    found = _compare(blocks, tiles, run)
    finished = todo.select("pg", "qg", "level", "most", F.lit(run).cast("long").alias("run"), F.lit(0).cast("long").alias("pairs"))
    if store is None:
        summary, current = stage(found, "compared"), finished
    else:
        new = store.write(found, "summary", run)
        # What was compared before counts where both groups stand and it was not compared again.
        before = done.join(needed.select("pg", "qg", "level"), ["pg", "qg", "level"], "left_semi")
        before = before.join(todo.select("pg", "qg", "level"), ["pg", "qg", "level"], "left_anti")
        current = store.write(before.unionByName(finished), "done", run)
        used = sorted(r.run for r in current.select("run").distinct().collect())
        summary = store.read("summary", SUMMARY, [n for n in used if n != run]).unionByName(new)
        if not runs:
            given = [] if pivots is None else [(i, v.tolist()) for i, v in enumerate(pivots)]
            store.write(spark.createDataFrame(given, PIVOTS), "pivots", run)

    # The graph of each scope: what was kept of its pairs of groups, at its distance.
    asked = together.select(*keys, "pg", "qg", F.col("eps").alias("level"), "min_samples")
    asked = asked.join(small(current.select("pg", "qg", "level", "run")), ["pg", "qg", "level"])
    edges = Observation()
    graph = summary.join(asked, ["pg", "qg", "level", "run"]).select(
        *keys, "kind", "a", "b", "age", "first_id", "min_samples"
    )
    # Degrees are summed before they are written; those of one task's tiles before they are shuffled.
    degrees = graph.filter(F.col("kind") == DEGREE).groupBy(*keys, "kind", "a").agg(
        F.sum("b").alias("b"), *[F.max(c).alias(c) for c in ("age", "first_id", "min_samples")]
    )
    graph = degrees.unionByName(graph.filter(F.col("kind") != DEGREE))
    graph = stage(graph.observe(edges, F.count_if(F.col("kind") != DEGREE).alias("edges")), "summary")
    scoped = placed.select(*keys, "id", "create_time", "rep")
    labels = label_rows(scoped, graph, keys, rows, edges.get["edges"], task_edges)
    if store is not None:
        store.write(everyone, "members", run)
        first = (runs or [run])[0]
        store.keep(sorted({first, run, *runs[-1:], *born, *used}))
    return Compared(labels, pairs, tile_count, alive.select("grp").distinct().count())


def scope_labels(
    candidates: DataFrame, vectors: DataFrame, keys: list[str], store: GraphStore | None = None,
    block_rows: int = BLOCK_ROWS, **options,
) -> DataFrame:
    """Labels of scopes that may have rows in common. Where all rows together fit one block, each scope is
    compared in one task, which takes fewer jobs; beyond that, or with a store, common rows are compared once."""
    candidates, counted = staged_candidates(candidates)
    if store is None and counted[0] <= block_rows:
        return dbscan_labels(candidates, vectors, keys, block_rows, counted=counted, **options)
    return shared_labels(candidates, vectors, keys, store, block_rows, counted=counted, **options).labels


def store_path(spark: SparkSession) -> str:
    return scratch_path(spark, "graph")
