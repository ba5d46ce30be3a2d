"""Token ids as length-delimited binary records, with an offset index beside them.

A record frames one document: length of the payload (8 bytes), masked CRC of these 8 bytes (4),
payload, masked CRC of the payload (4), one line feed; numbers are little-endian. The payload is
a flag byte (1: the document has an id), the bytes per token id (2 or 4), doc_id (8) and the ids. The
CRC is zlib's CRC-32, masked by a rotation of 15 bits and a constant, as checksums of data that
itself holds checksums should be. The line feed comes from Spark's text sink, which writes the
files: so they can be in any store that Spark knows, and commit as its task output does.

Documents are dealt out by ranges of doc_id, so files and records within are in its order. The
index is made from the files: for each record its file, offset and length, which is what a
shuffled reader needs, and the number of tokens before it.

Defined results: a null text is a record of the end id only. A null doc_id sorts first. Rows of
one doc_id stay together, ordered by text. An empty table gives no records. Damaged or cut-off
records raise an error. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsburst.llm.common import give_back, slices
from newsburst.llm.wordids import word_ids
from newsburst.session import scratch_path, stage

SLICE_BYTES = 8 << 20
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def frames(content: bytes):
    """(offset, length of the whole record, payload) of a file's records; checks all checksums."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if len(content) - at < 17:
            raise ValueError(f"record cut off at {at}")
        size, head_crc = struct.unpack_from("<QI", content, at)
        if masked(view[at : at + 8]) != head_crc or at + 17 + size > len(content):
            raise ValueError(f"damaged record length at {at}")
        payload = view[at + 12 : at + 12 + size]
        if masked(payload) != struct.unpack_from("<I", content, at + 12 + size)[0] or content[at + 16 + size] != 10:
            raise ValueError(f"damaged record at {at}")
        yield at, size + 17, payload
        at += size + 17


def payload_of(doc_id: int | None, ids: bytes | memoryview, width: int) -> bytes:
    return b"".join((struct.pack("<BBq", doc_id is not None, width, doc_id or 0), ids))


def parse(payload) -> tuple[int | None, np.ndarray]:
    known, width, doc_id = struct.unpack_from("<BBq", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=10)


def write_records(docs: DataFrame, model: str, end_id: int, path: str) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer ``model`` (its JSON), ``end_id`` last in
    each document, into record files under ``path``."""

    def encode(batches):
        give_back()
        coder = word_ids(model)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        for batch in slices(batches, "text", SLICE_BYTES):
            offsets, ids = coder.encode(batch.column("text"))
            held = memoryview(np.insert(ids, offsets[1:], end_id).astype(f"<u{width}").tobytes())
            ends = (width * (offsets + np.arange(len(offsets)))).tolist()
            rows = [
                frame(payload_of(d, held[a:b], width))
                for d, a, b in zip(batch.column("doc_id").to_pylist(), ends, ends[1:])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    records = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(encode, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.text(path, lineSep="\n")


_INDEX = "file string, doc_id long, offset long, length long, n_tokens long, before long, ids_crc32 long"


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the files: place, tokens in and before it, CRC of its ids as
    4-byte numbers. ``before`` counts within the file."""

    def read(batches):
        names = [c.split()[0] for c in _INDEX.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, before = [], 0
                for offset, length, payload in frames(content.as_py()):
                    doc_id, ids = parse(payload)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((file, doc_id, offset, length, len(ids), before, crc))
                    before += len(ids)
                columns = list(zip(*rows)) or [()] * len(names)
                kinds = [pa.string()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, _INDEX)


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the record files, written to the shared folder and read again: file, offset,
    length, doc_id, start (tokens of all records before), n_tokens, ids_crc32."""
    scanned = stage(scan_records(spark, path), "record_scan")
    totals = scanned.groupBy("file").agg(
        F.min(F.struct("doc_id")).alias("first"), F.sum("n_tokens").alias("held")
    )
    # One row per file: a running total over the files is small.
    earlier = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    return scanned.join(bases, "file").select(
        "file", "offset", "length", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of all records."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                parsed = [parse(p) for _, _, p in frames(content.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in parsed], pa.int64()),
                        pa.array([i.astype(np.int64) for _, i in parsed], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "ids"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, "doc_id long, ids array<long>")


def record_path(spark: SparkSession) -> str:
    return scratch_path(spark, "records")
