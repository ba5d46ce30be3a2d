"""Texts dealt into chunks by ranges of doc_id, and sorted fingerprints sent from chunks to buckets."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsburst.llm.common import texts

CHUNK_BYTES = 8 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_prints(hashes: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of each run of ``length`` words, from the words' hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total = total * FACTOR + hashes[j : j + n]
    return mix(total)


def bucket_bounds(n_buckets: int) -> np.ndarray:
    return np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], np.uint64)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane, which compresses well."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def chunk_cuts(docs: DataFrame, chunk_bytes: int) -> list[int]:
    """Smallest doc_id of each chunk but the first, by quantiles of the bytes of text; a doc_id that
    alone holds more than a chunk comes up several times."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    n = max(1, math.ceil((docs.agg(F.sum(size)).first()[0] or 0) / chunk_bytes))
    if n == 1:
        return []
    # A row counts once for each such share of a chunk, what is left by chance.
    share = max(1, chunk_bytes // 256)
    times = F.floor(size / share + F.rand(7)).cast("int")
    counted = docs.select("doc_id", F.explode(F.array_repeat(F.lit(0), times)))
    cuts = counted.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    return sorted(cuts or [])


def dealing(cuts: list[int]) -> tuple[list[int], list[int]]:
    """Bounds of the ranges of doc_id, and the number of chunks of each: several only for a doc_id
    that comes up several times, which then has a range of its own."""
    often = {c: n for c, n in Counter(cuts).items() if n > 1}
    bounds = sorted(set(cuts) | {c + 1 for c in often if c < 2**63 - 1})
    return bounds, [1, *(often.get(b, 1) for b in bounds)]


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt_by_chunk(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, list[int]]:
    """(chunk, doc_id, text), shuffled by chunk, and the number of the range of doc_id of each
    chunk: chunks of one range hold rows of one doc_id, dealt by their texts."""
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges, parts = dealing(chunk_cuts(known, chunk_bytes))
    bounds, parts = np.array(ranges, np.int64), np.array(parts)
    firsts = np.cumsum(parts) - parts

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, ids, side="right")
            chunk = firsts[at]
            many = np.flatnonzero(parts[at] > 1)
            if len(many):
                held = texts(batch.column("text").take(pa.array(many)))
                chunk[many] += np.array([zlib.crc32(t) for t in held], np.int64) % parts[at[many]]
            yield pa.RecordBatch.from_arrays([pa.array(chunk.astype(np.int32)), *batch.columns], ["chunk", "doc_id", "text"])

    # Without nulls in the key no join adds a filter below the exchange, so all uses share it.
    dealt = known.mapInArrow(deal, "chunk int not null, doc_id long, text string")
    return dealt.repartition(partitions(docs), "chunk"), np.repeat(np.arange(len(parts)), parts).tolist()


def table_of(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, columns)})


def schema_of(fields: list[tuple]) -> str:
    names = {pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[k]} not null" for n, k in fields)


