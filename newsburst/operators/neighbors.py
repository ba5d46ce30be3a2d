"""Exact cosine neighbourhoods over a grid of blocks.

The points of one scope (a tenant, or a tenant at one time tick) are cut into blocks of
bounded size. Every pair of blocks that can hold neighbours is one tile, and one task
compares the two blocks with a matrix product. A tile never emits all its pairs. It emits

* per point, its number of neighbours inside the tile;
* for points that are already dense inside the tile, one edge each to the smallest member
  of their tile-local component (a spanning forest keeps connectivity);
* for the other points, all their edges - fewer than ``min_samples`` per point.

That is enough to finish density clustering without touching the vectors again.

A scope has at most about ``MOST_BLOCKS`` blocks while these stay within ``BLOCK_BYTES``: a block is copied to every
tile it is part of, so more blocks would be more copies. A task compares a tile in strips and puts together what they
gave, so its memory does not grow with the square of its blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.operators.components import spanning_forest
from newsburst.schemas import INT, LONG, table
from newsburst.session import single_threaded_blas

BLOCK_ROWS = 8192
CHUNK_ROWS = 256
# Larger blocks than asked for are made where a scope would have more than this many, up to these bytes of vectors.
MOST_BLOCKS = 16
BLOCK_BYTES = 32 << 20
# Rows of a tile's side that are compared at once, and edges kept before they are reduced.
STRIP_ROWS = 2048
PENDING_EDGES = 500_000
MAX_PIVOTS = 32
DEGREE, FOREST, SPARSE = 0, 1, 2


def _matrix(column, rows: int | None = None) -> np.ndarray:
    """An Arrow list column, or binary column of one or more vectors a row, as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column) if rows is None else rows
    if n == 0:
        return np.zeros((0, 0), dtype=np.float32)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(n, -1)
    lengths = np.asarray(column.value_lengths())
    if lengths.min() != lengths.max():
        raise ValueError("vectors of different dimensions cannot be clustered together")
    return column.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(n, -1)


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
    safe = np.where(norms == 0, 1.0, norms)
    return (matrix / safe[:, None]).astype(np.float32), norms


PACKED = table(
    id=LONG,
    vec=T.BinaryType(),
    digest=T.BinaryType(),
    cells=T.ArrayType(INT),
    angles=T.ArrayType(T.FloatType()),
)


def pack_vectors(vectors: DataFrame, pivots: np.ndarray | None = None) -> DataFrame:
    """(id, embedding) to compact rows: raw float32 bytes, a digest that is equal for equal
    vectors, and for 1, 2, 4, ... pivots the nearest pivot and the angle to it."""
    levels = [] if pivots is None else [1 << k for k in range(int(math.log2(len(pivots))) + 1)]

    def pack(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column("embedding")) + np.float32(0.0)
            raw = matrix.tobytes()
            width = matrix.shape[1] * 4
            unit, norms = _unit(matrix)
            digests = []
            for i in range(n):
                # A zero vector is at distance one from its own copies: never merged.
                own = b"" if norms[i] else int(ids[i]).to_bytes(8, "big", signed=True)
                piece = raw[i * width : (i + 1) * width]
                digests.append(hashlib.blake2b(piece + own, digest_size=16).digest())
            cells = np.zeros((n, max(len(levels), 1)), dtype=np.int32)
            angles = np.zeros((n, max(len(levels), 1)), dtype=np.float32)
            if levels:
                spread = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))
                for k, count in enumerate(levels):
                    cells[:, k] = spread[:, :count].argmin(axis=1)
                    angles[:, k] = spread[:, :count].min(axis=1)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * cells.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([raw[i * width : (i + 1) * width] for i in range(n)], pa.binary()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(cells.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(angles.ravel())),
                ],
                names=PACKED.names,
            )

    single_threaded_blas(vectors.sparkSession)
    return vectors.select("id", "embedding").mapInArrow(pack, PACKED)


def choose_pivots(vectors: DataFrame, blocks: int) -> np.ndarray:
    """At most ``MAX_PIVOTS`` vectors picked by hash order, as unit rows.

    This is all that ever reaches the driver: a fixed number of vectors. They only steer
    which points share a block; the result does not depend on them.
    """
    wanted = min(MAX_PIVOTS, 1 << max(1, int(math.log2(max(blocks, 1)))))
    rows = (
        vectors.select(F.xxhash64("id").alias("h"), "embedding").orderBy("h").limit(wanted).collect()
    )
    unit, _ = _unit(np.array([r["embedding"] for r in rows], dtype=np.float32))
    return unit[: 1 << int(math.log2(len(unit)))]


def bounded_blocks(block_rows: int, rows: int, dimension: int) -> int:
    """Rows a block: as asked for, more where ``rows`` would need more than ``MOST_BLOCKS`` blocks."""
    most = max(block_rows, BLOCK_BYTES // (4 * max(1, dimension)))
    return max(block_rows, min(most, math.ceil(rows / MOST_BLOCKS)))


def assign_blocks(points: DataFrame, keys: list[str], block_rows: int, levels: int) -> DataFrame:
    """Add ``cell``, ``angle`` and ``block``; ``points`` carries ``scope_rows``.

    A scope uses at most as many pivot cells as it needs blocks, and a cell with more than
    ``block_rows`` points is split evenly by hash, so a hot cell cannot make a large block.
    """
    needed = F.ceil(F.col("scope_rows") / F.lit(block_rows)).cast("double")
    level = F.least(F.floor(F.log2(F.greatest(needed, F.lit(1.0)))).cast("int"), F.lit(levels - 1))
    points = points.withColumn("_level", level + 1).select(
        *[c for c in points.columns if c not in ("cells", "angles")],
        F.element_at("cells", F.col("_level")).alias("cell"),
        F.element_at("angles", F.col("_level")).alias("angle"),
    )
    cells = points.groupBy(*keys, "cell").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("_parts")
    )
    part = F.pmod(F.xxhash64("id"), F.col("_parts").cast("long")).cast("int")
    return points.join(cells, [*keys, "cell"]).withColumn("part", part).drop("_parts")


def chunk_blocks(points: DataFrame, keys: list[str]) -> DataFrame:
    """Turn the points of each block into few rows of up to ``CHUNK_ROWS`` points.

    Blocks are copied to every tile they are part of; copying a handful of large binary
    rows is far cheaper than shuffling and sorting thousands of small ones. The order of
    a block's points does not matter. ``angle`` becomes the largest of the chunk.
    """
    lists = ["id", "mult", "age", "first_id"]
    constant = [*keys, "cell", "part", "eps", "min_samples"]
    fields = [points.schema[c] for c in constant]
    schema = T.StructType(
        fields
        + table(angle=T.FloatType()).fields
        + [T.StructField(c, T.ArrayType(LONG)) for c in lists]
        + table(vec=T.BinaryType()).fields
    )

    def chunk(block: pa.Table) -> pa.Table:
        n = block.num_rows
        bounds = np.append(np.arange(0, n, CHUNK_ROWS), n)
        count = len(bounds) - 1
        angle = block.column("angle").to_numpy()
        raw = block.column("vec").to_pylist()
        columns = [pa.repeat(block.column(c)[0], count) for c in constant]
        columns.append(pa.array([angle[a:b].max() for a, b in zip(bounds, bounds[1:])], pa.float32()))
        offsets = pa.array(bounds.astype(np.int32))
        columns += [
            pa.ListArray.from_arrays(offsets, pa.array(block.column(c).to_numpy())) for c in lists
        ]
        columns.append(pa.array([b"".join(raw[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()))
        return pa.Table.from_arrays(columns, names=schema.names)

    rows = points.select(*constant, "angle", *lists, "vec")
    return rows.groupBy(*keys, "cell", "part").applyInArrow(chunk, schema)


def tile_list(
    points: DataFrame, keys: list[str], pivots: np.ndarray | None
) -> DataFrame:
    """Pairs of blocks that may hold neighbours: (keys, p block, q block), p <= q.

    Each block lies in a ball around its cell's pivot. When the gap between two balls
    exceeds the neighbourhood angle, no pair of the tile can be a neighbour pair (triangle
    inequality on angles) and the tile is dropped. Works on one row per block.
    """
    spark = points.sparkSession
    blocks = points.groupBy(*keys, "cell", "part").agg(
        F.max("angle").alias("radius"), F.max("eps").alias("eps")
    )
    p = blocks.select(
        *keys, "eps", F.col("cell").alias("pc"), F.col("part").alias("pp"), F.col("radius").alias("pr")
    )
    q = blocks.select(
        *keys, F.col("cell").alias("qc"), F.col("part").alias("qp"), F.col("radius").alias("qr")
    )
    ordered = (F.col("pc") < F.col("qc")) | (
        (F.col("pc") == F.col("qc")) & (F.col("pp") <= F.col("qp"))
    )
    tiles = p.join(q, keys).filter(ordered)
    if pivots is not None and len(pivots) > 1:
        between = np.arccos(np.clip(pivots.astype(np.float64) @ pivots.T.astype(np.float64), -1, 1))
        gaps = spark.createDataFrame(
            [
                (i, j, float(between[i, j]) if i != j else 0.0)
                for i in range(len(pivots))
                for j in range(len(pivots))
            ],
            "pc INT, qc INT, gap DOUBLE",
        )
        reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("eps"))))
        slack = F.lit(2e-3)
        tiles = tiles.join(gaps, ["pc", "qc"]).filter(
            F.col("gap") - F.col("pr") - F.col("qr") <= reach + slack
        )
    return tiles.select(*keys, "pc", "pp", "qc", "qp")


def _adjacency(rows, cols, eps: float) -> np.ndarray:
    """Which (row, col) pairs are neighbours. The product runs in float32; pairs that are
    closer to the threshold than its rounding error are decided again in float64."""
    row_unit, row_norm = _unit(rows)
    col_unit, col_norm = _unit(cols)
    dim = rows.shape[1]
    threshold = 1.0 - eps
    tolerance = 2.0 * (dim + 8) * 6e-8
    result = np.empty((len(rows), len(cols)), dtype=bool)
    strip = max(1, (16 << 20) // max(1, 4 * len(cols)))
    for start in range(0, len(rows), strip):
        stop = min(len(rows), start + strip)
        similarity = row_unit[start:stop] @ col_unit.T
        sure = np.greater_equal(similarity, threshold + tolerance, out=result[start:stop])
        maybe = similarity >= threshold - tolerance
        if np.count_nonzero(sure) == np.count_nonzero(maybe):
            continue
        close_i, close_j = np.nonzero(maybe ^ sure)
        for at in range(0, len(close_i), 4096):
            i = close_i[at : at + 4096] + start
            j = close_j[at : at + 4096]
            dots = np.einsum("ij,ij->i", rows[i].astype(np.float64), cols[j].astype(np.float64))
            norms = row_norm[i] * col_norm[j]
            cosine = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
            result[i, j] = 1.0 - cosine <= eps
    return result


def distance_levels(rows, cols, levels: np.ndarray) -> np.ndarray:
    """For each (row, col) pair the place of the smallest of the ascending ``levels`` that its distance
    does not exceed, their number where there is none; decided like ``_adjacency``."""
    row_unit, row_norm = _unit(rows)
    col_unit, col_norm = _unit(cols)
    tolerance = 2.0 * (rows.shape[1] + 8) * 6e-8
    result = np.full((len(rows), len(cols)), len(levels), dtype=np.uint8)
    strip = max(1, (16 << 20) // max(1, 4 * len(cols)))
    for start in range(0, len(rows), strip):
        stop = min(len(rows), start + strip)
        similarity = row_unit[start:stop] @ col_unit.T
        part = result[start:stop]
        close = np.zeros(similarity.shape, dtype=bool)
        for place in range(len(levels) - 1, -1, -1):
            threshold = 1.0 - levels[place]
            part[similarity >= threshold] = place
            close |= np.abs(similarity - threshold) <= tolerance
        close_i, close_j = np.nonzero(close)
        for at in range(0, len(close_i), 4096):
            i, j = close_i[at : at + 4096] + start, close_j[at : at + 4096]
            dots = np.einsum("ij,ij->i", rows[i].astype(np.float64), cols[j].astype(np.float64))
            norms = row_norm[i] * col_norm[j]
            cosine = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
            result[i, j] = np.searchsorted(levels, 1.0 - cosine, side="left")
    return result


def _bipartite_components(adjacency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of rows and columns; each row of the matrix is read once."""
    transposed = np.ascontiguousarray(adjacency.T)
    row_label = np.full(adjacency.shape[0], -1, dtype=np.int64)
    col_label = np.full(adjacency.shape[1], -1, dtype=np.int64)
    for seed in range(len(row_label)):
        if row_label[seed] >= 0:
            continue
        row_label[seed] = seed
        front = np.array([seed])
        while front.size:
            cols = np.flatnonzero(adjacency[front].any(axis=0) & (col_label < 0))
            col_label[cols] = seed
            if not cols.size:
                break
            front = np.flatnonzero(transposed[cols].any(axis=0) & (row_label < 0))
            row_label[front] = seed
    return row_label, col_label


def _weighted_degree(near: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Neighbours per row, a collapsed group of copies counting as many as it holds."""
    if (mult == 1).all():
        return np.count_nonzero(near, axis=1)
    degree = np.empty(len(near), dtype=np.int64)
    for start in range(0, len(near), 512):
        degree[start : start + 512] = near[start : start + 512].astype(np.float64) @ mult
    return degree


def tile_parts(near, row_ids, row_mult, col_ids, col_mult, diagonal, min_samples):
    """Degrees and edges of a tile whose neighbour pairs are known."""
    if diagonal:
        np.fill_diagonal(near, True)
    row_degree = _weighted_degree(near, col_mult)
    col_degree = row_degree if diagonal else _weighted_degree(near.T, row_mult)
    out = [(DEGREE, row_ids, row_degree)]
    if not diagonal:
        out.append((DEGREE, col_ids, col_degree))
    row_dense = np.flatnonzero(row_degree >= min_samples)
    col_dense = np.flatnonzero(col_degree >= min_samples)
    if row_dense.size and col_dense.size:
        row_label, col_label = _bipartite_components(near[np.ix_(row_dense, col_dense)])
        members, labels = row_ids[row_dense], row_label
        if not diagonal:
            members = np.concatenate([members, col_ids[col_dense]])
            labels = np.concatenate([labels, col_label])
        members, labels = members[labels >= 0], labels[labels >= 0]
        order = np.lexsort((members, labels))
        members, labels = members[order], labels[order]
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        roots = np.repeat(members[starts], np.diff(np.r_[starts, len(labels)]))
        useful = members != roots
        out.append((FOREST, members[useful], roots[useful]))
    row_sparse = np.flatnonzero((row_degree > 0) & (row_degree < min_samples))
    i, j = np.nonzero(near[row_sparse])
    i = row_sparse[i]
    if not diagonal:
        col_sparse = np.flatnonzero((col_degree > 0) & (col_degree < min_samples))
        rest_i, rest_j = np.nonzero(near[:, col_sparse])
        rest_j = col_sparse[rest_j]
        new = row_degree[rest_i] >= min_samples
        i, j = np.r_[i, rest_i[new]], np.r_[j, rest_j[new]]
    a, b = row_ids[i], col_ids[j]
    keep = a != b
    out.append((SPARSE, a[keep], b[keep]))
    return out


class _Merged:
    """Degrees and edges of a tile, put together from those of its strips; points go by their place in the tile.

    A point that is dense in a strip is dense in the tile. Edges of which both ends became dense join the forest, so
    what is kept stays below ``min_samples`` edges a point and one forest.
    """

    def __init__(self, points: int, min_samples: int):
        self.degree = np.zeros(points, np.int64)
        self.min_samples = min_samples
        self.kept = {FOREST: [], SPARSE: []}
        self.pending = 0

    def add(self, parts) -> None:
        for kind, a, b in parts:
            if kind == DEGREE:
                self.degree[a] += b  # the places of one strip are distinct
            elif len(a):
                self.kept[kind].append((a, b))
                self.pending += len(a)
        if self.pending > PENDING_EDGES:
            self._reduce()

    def _edges(self, kind):
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate([empty, *(part[k] for part in self.kept[kind])]) for k in (0, 1))

    def _reduce(self) -> None:
        a, b = self._edges(SPARSE)
        dense = self.degree >= self.min_samples
        inner = dense[a] & dense[b]
        forest = self._edges(FOREST)
        forest = spanning_forest(np.r_[forest[0], a[inner]], np.r_[forest[1], b[inner]])
        self.kept = {FOREST: [forest], SPARSE: [(a[~inner], b[~inner])]}
        self.pending = 0

    def parts(self, ids: np.ndarray):
        """As of ``tile_parts``, every point with its degree."""
        self._reduce()
        parts = [(DEGREE, ids, self.degree)]
        for kind in (FOREST, SPARSE):
            a, b = (ids[side] for side in self._edges(kind))
            parts.append((kind, a[a != b], b[a != b]))
        return parts


def compare_strips(ids, mult, p, q, diagonal: bool, near, levels: int, min_samples: int):
    """Per level the degrees and edges of a tile of the points at places ``p`` and ``q``; ``near`` tells for the places
    of two strips, level by level, which pairs are neighbours."""
    # Places in the order of ids, so that the smallest place of a component is its smallest member.
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    merged = [_Merged(len(ids), min_samples) for _ in range(levels)]
    for i in range(0, len(p), STRIP_ROWS):
        rows = p[i : i + STRIP_ROWS]
        for j in range(i if diagonal else 0, len(q), STRIP_ROWS):
            cols = q[j : j + STRIP_ROWS]
            same = diagonal and i == j
            for found, at in zip(merged, near(rows, cols)):
                found.add(tile_parts(at, place[rows], mult[rows], place[cols], mult[cols], same, min_samples))
    return [found.parts(ids[order]) for found in merged], order


def neighbour_summary(
    points: DataFrame, tiles: DataFrame | None, keys: list[str], tile_count: int
) -> DataFrame:
    """Compare all tiles. ``points``: keys, id, mult, age, first_id, vec, eps, min_samples;
    without ``tiles`` every scope is a single block, with them rows are chunks of a block.

    Result rows are (keys, kind, a, b, age, first_id, min_samples): kind 0 = id and
    neighbour count, 1 = forest edge of dense points, 2 = edge of a sparse point. The last
    three columns repeat the point's own values on rows of kind 0.
    """
    schema = T.StructType(
        [points.schema[k] for k in keys]
        + table(kind=T.ByteType(), a=LONG, b=LONG, age=LONG, first_id=LONG, min_samples=INT).fields
    )
    if tiles is None:
        sided = points.withColumns(
            {"pc": F.lit(0), "pp": F.lit(0), "qc": F.lit(0), "qp": F.lit(0), "side": F.lit(2)}
        )
    else:
        same = (F.col("pc") == F.col("qc")) & (F.col("pp") == F.col("qp"))
        as_p = tiles.select(
            "*",
            F.col("pc").alias("cell"),
            F.col("pp").alias("part"),
            F.when(same, 2).otherwise(0).alias("side"),
        )
        as_q = tiles.filter(~same).select(
            "*", F.col("qc").alias("cell"), F.col("qp").alias("part"), F.lit(1).alias("side")
        )
        sided = points.join(as_p.unionByName(as_q), [*keys, "cell", "part"])
    tile = [*keys, "pc", "pp", "qc", "qp"]
    chunked = tiles is not None
    sided = sided.select(
        *tile, "side", "id", "mult", "age", "first_id", "vec", "eps", "min_samples"
    )

    def compare(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        columns = [block.column(c).combine_chunks() for c in ("id", "mult", "age", "first_id")]
        if chunked:
            side = np.repeat(side, np.asarray(columns[0].value_lengths()))
            columns = [c.flatten() for c in columns]
        ids, mult, age, first_id = (c.to_numpy() for c in columns)
        eps = block.column("eps")[0].as_py()
        min_samples = block.column("min_samples")[0].as_py()
        vectors = _matrix(block.column("vec"), len(ids))
        diagonal = bool(side[0] == 2)
        p = np.flatnonzero(side != 1)
        q = p if diagonal else np.flatnonzero(side == 1)
        (parts,), own = compare_strips(
            ids, mult, p, q, diagonal, lambda i, j: [_adjacency(vectors[i], vectors[j], eps)], 1, min_samples
        )
        kind = np.concatenate([np.full(len(a), k, dtype=np.int8) for k, a, _ in parts])

        def per_point(values):
            return pa.array(values[own]), pa.nulls(len(kind) - len(own), pa.int64())

        columns = [pa.repeat(block.column(k)[0], len(kind)) for k in keys]
        columns += [pa.array(kind)]
        columns += [
            pa.array(np.concatenate([np.asarray(part[slot], dtype=np.int64) for part in parts]))
            for slot in (1, 2)
        ]
        columns += [pa.concat_arrays(per_point(values)) for values in (age, first_id)]
        columns += [pa.repeat(pa.scalar(min_samples, pa.int32()), len(kind))]
        return pa.Table.from_arrays(columns, names=schema.names)

    single_threaded_blas(points.sparkSession)
    partitions = max(1, min(4 * tile_count, 20000))
    return sided.repartition(partitions, *tile).groupBy(*tile).applyInArrow(compare, schema)
