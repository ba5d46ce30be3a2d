"""Packing by powers of two: each document is cut into pieces as its length is written in binary, and
every piece is a sequence of its own, in the bucket of its length.

A document of n tokens gives n // most pieces of ``most`` tokens, then one for each binary digit of
what is left, longest first. So no sequence crosses documents, none is padded, and a batch is
drawn from one bucket. Sequences are written as Parquet in one folder per length, with their ids as
little-endian 4-byte numbers; ``sequences`` reads them back and numbers them without gaps,
bucket after bucket from the longest. A task's place in its bucket is known where it is made, so numbers
need the counts per task only, not a sort.

Documents stay in the partitions in which they are read; no document meets another. Ids come from
``wordids``.

Defined results: a null text is a document of the end id only; with no end id it has no piece, like an
empty one. A null doc_id stays. Each row is a document, also where doc_ids or texts are equal.
An empty table gives no sequences. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsburst.llm.common import slices
from newsburst.llm.wordids import word_ids
from newsburst.session import scratch_path, spread

SLICE_BYTES = 8 << 20
MOST = 4096
#: A table of at most so many short rows is broadcast, after it was counted.
BROADCAST_ROWS = 100_000
_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
        ("task", pa.int32()), ("place", pa.int64()), ("length", pa.int64()),
    ]
)
_SCHEMA = "doc_id long, start long, doc_tokens long, ids binary, task int, place long, length long"


def piece_lengths(sizes: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(number of its document, length) of all pieces of documents of the given sizes, in order."""
    owners, lengths = [], []
    for shift in range(most.bit_length() - 1, -1, -1):
        times = sizes // most if 1 << shift == most else (sizes >> shift) & 1
        owners.append(np.repeat(np.arange(len(sizes)), times))
        lengths.append(np.full(len(owners[-1]), 1 << shift))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(owners)[order], np.concatenate(lengths)[order]


def write_sequences(docs: DataFrame, model: str, end_id: int | None, path: str, most: int = MOST) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer ``model`` (its JSON), ``end_id`` behind each
    document, cut them and write the sequences under ``path``."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def cut(batches):
        coder = word_ids(model)
        task = TaskContext.get().partitionId()
        held = np.zeros(most.bit_length(), np.int64)  # sequences of this task so far, by length
        for batch in slices(batches, "text", SLICE_BYTES):
            offsets, ids = coder.encode(batch.column("text"))
            ids = np.insert(ids, np.repeat(offsets[1:], len(end)), np.tile(end, batch.num_rows)).astype("<u4")
            sizes = np.diff(offsets) + len(end)
            owner, length = piece_lengths(sizes, most)
            if not len(owner):
                continue
            upto = np.cumsum(length)
            start = upto - length - (np.cumsum(sizes) - sizes)[owner]
            place = np.empty(len(length), np.int64)
            for bit in range(most.bit_length()):
                mine = np.flatnonzero(length == 1 << bit)
                place[mine] = held[bit] + np.arange(len(mine))
                held[bit] += len(mine)
            at = np.concatenate([[0], 4 * upto])
            parts = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(length), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]
            )
            columns = [
                batch.column("doc_id").take(pa.array(owner)), start, sizes[owner], parts.cast(pa.binary()),
                np.full(len(length), task, np.int32), place, length,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)

    rows = spread(docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")))
    made = rows.mapInArrow(cut, _SCHEMA)
    made.write.option("compression", "zstd").partitionBy("length").parquet(path)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, doc_id, start, length, doc_tokens, ids) of the written sequences: numbers run
    from 0 through the bucket of the longest, then the next."""
    made = spark.read.schema(_SCHEMA).parquet(path)
    counts = made.groupBy("length", "task").agg(F.count("*").alias("held"))
    lengths = made.groupBy("length").agg(F.count("*").alias("held"))
    # One row per length, and per length and task.
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = lengths.select("length", F.coalesce(F.sum("held").over(longer), F.lit(0)).alias("bucket"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).join(
        F.broadcast(buckets), "length"
    )
    bases = bases.select("length", "task", (F.col("bucket") + F.col("before")).alias("base"))
    few = bases.count() <= BROADCAST_ROWS
    return made.join(F.broadcast(bases) if few else bases, ["length", "task"]).select(
        (F.col("base") + F.col("place")).alias("sequence_id"), "doc_id", "start", "length", "doc_tokens", "ids"
    )


def sequence_path(spark: SparkSession) -> str:
    return scratch_path(spark, "sequences")
