"""Removal of long repeated passages by compaction of a token De Bruijn graph.

Edges are k-mers of ``window`` words, nodes the words that consecutive edges share. A repeated
edge occurs in an earlier document too. Where repeated edges follow each other both in a document
and at their first source, the path between them does not branch: it compacts into one span
(document, start, words, source document, source start). Spans are proven word by word at the
source's coordinates before anything is removed.

How it is spread: documents are dealt into chunks by ranges of doc_id, so that "earlier document"
is an earlier chunk, or the same one. Texts are shuffled once, by chunk; that exchange serves all
steps.

1. Each chunk sends its distinct edge fingerprints, sorted and packed, to fingerprint buckets. So
   an edge that a third of all documents hold is one entry per chunk: no hot key.
2. A bucket answers each chunk which of its edges an earlier chunk has, and the first that does.
3. A chunk cuts its documents into paths with one source chunk and sends the distinct paths there.
4. The source chunk joins them with its own edges: finds, proves and compacts them into spans.
5. Each chunk takes the spans' words out of its documents.

A chunk is about ``chunk_bytes`` of text and a bucket as many edges as two chunks have; both are
counted from the input, so memory per task stays the same at any size. The driver holds one
doc_id per chunk. A repeated edge can be missed only if a different edge of an earlier chunk has
its 64-bit fingerprint: a chance of the number of edges over 2^64 for each.

Words are runs of characters other than space and ``\\t`` to ``\\r``. Defined results: null texts have no
words. Rows with a null doc_id have no order: they lose nothing and are no source. Rows of one
doc_id are not earlier than each other. Texts shorter than a window are kept. An empty table gives
none. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsburst.llm.chunks import (
    CHUNK_BYTES,
    bucket_bounds,
    dealt_by_chunk,
    packed,
    partitions,
    run_prints,
    schema_of,
    table_of,
    unpacked,
)
from newsburst.llm.common import give_back, slices

WINDOW = 13
#: More bytes of paths to one source chunk than this are dealt to copies of it.
PATH_BYTES = 32 << 20


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, one after another, and the number of each text's; a null text has none."""
    split = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    words, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    # White space at either end leaves an empty word.
    some = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), np.diff(upto[ends - ends[0]])


def distinct(values: np.ndarray) -> np.ndarray:
    """As numpy.unique, which hashes long arrays: sorting takes a fraction of its time."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


@dataclass
class Chunk:
    """The documents of one chunk in the order of (doc_id, text), as one run of words, numbered by ``index``."""

    window: int
    doc_ids: np.ndarray
    words: pa.Array
    sizes: np.ndarray

    def __post_init__(self):
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes

    @classmethod
    def of(cls, table: pa.Table, window: int) -> Chunk:
        ids, text = (table.column(c).combine_chunks() for c in ("doc_id", "text"))
        rows = pa.table({"doc_id": ids, "text": text.cast(pa.large_string()).fill_null("")})
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")]))
        return cls(window, rows.column(0).to_numpy(), *split_words(rows.column(1).combine_chunks()))

    def index(self) -> None:
        coded = self.words.dictionary_encode()
        self.held = coded.dictionary.cast(pa.large_binary()).to_pylist()
        self.ids = coded.indices.to_numpy()
        self.word_hash = np.array(list(map(xxhash.xxh3_64_intdigest, self.held)), np.uint64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.prints = run_prints(self.word_hash[self.ids], self.window)
        whole = self.doc[: len(self.prints)] == self.doc[self.window - 1 :][: len(self.prints)]
        self.starts = np.flatnonzero(whole)
        self.prints = self.prints[self.starts]


_EDGES = [("bucket", pa.int32()), ("chunk", pa.int32()), ("edges", pa.binary())]
_REPEATED = [("chunk", pa.int32()), ("bucket", pa.int32()), ("places", pa.binary()), ("sources", pa.binary())]
_PATHS = [("source", pa.int32()), ("sender", pa.int32()), ("marks", pa.binary()), ("words", pa.binary())]
_SPANS = [("chunk", pa.int32()), ("spans", pa.binary())]


def _send_edges(window: int, n_buckets: int):
    bounds = bucket_bounds(n_buckets)

    def run(table: pa.Table) -> pa.Table:
        give_back()
        chunk = Chunk.of(table, window)
        chunk.index()
        edges = distinct(chunk.prints)
        number = table.column("chunk")[0].as_py()
        cuts = [0, *np.searchsorted(edges, bounds).tolist(), len(edges)]
        return table_of(
            [(b, number, packed(edges[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i], _EDGES
        )

    return run


def _answer(ranges: list[int]):
    """For one bucket: which entries of each chunk an earlier chunk has, and the first such."""
    place = np.array(ranges)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("edges").to_pylist()))
        lists = [unpacked(e, np.uint64) for _, e in rows]
        sizes = np.array([len(x) for x in lists])
        prints = np.concatenate(lists)
        chunk = np.repeat(np.array([c for c, _ in rows], np.int32), sizes)
        order = np.argsort(prints, kind="stable")  # equal prints stay in the order of chunks
        same = np.concatenate([[False], prints[order][1:] == prints[order][:-1]])
        group_start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        source = np.full(len(prints), -1, np.int32)
        source[order[same]] = chunk[order[group_start[same]]]
        # Chunks of one range hold one doc_id: none is earlier than another.
        source[(source >= 0) & (place[source] == place[chunk])] = -1
        result, at = [], 0
        for (number, _), size in zip(rows, sizes.tolist()):
            part = source[at : at + size]
            places = np.flatnonzero(part >= 0)
            if len(places):
                result.append((number, bucket, packed(places.astype(np.uint32)), part[places].tobytes()))
            at += size
        return table_of(result, _REPEATED)

    return run


def _cut_paths(window: int, n_buckets: int):
    bounds = bucket_bounds(n_buckets)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([], _PATHS)
        give_back()
        chunk = Chunk.of(table, window)
        chunk.index()
        edges, firsts, which = np.unique(chunk.prints, return_index=True, return_inverse=True)
        number = table.column("chunk")[0].as_py()
        base = [0, *np.searchsorted(edges, bounds).tolist()]
        source = np.full(len(edges), -1, np.int64)
        for b, places, sources in zip(*(answers.column(c).to_pylist() for c in ("bucket", "places", "sources"))):
            source[base[b] + unpacked(places, np.uint32)] = np.frombuffer(sources, np.int32)
        at = source[which]
        here = chunk.doc_ids[chunk.doc[chunk.starts]]
        earliest = here[firsts][which]
        at = np.where((at < 0) & (earliest < here), number, at)
        # Paths: consecutive edges of one document with one source.
        starts, doc = chunk.starts, chunk.doc[chunk.starts]
        follows = np.zeros(len(at), bool)
        follows[1:] = (starts[1:] == starts[:-1] + 1) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        heads = np.flatnonzero((at >= 0) & ~follows)
        tails = np.flatnonzero((at >= 0) & ~np.concatenate([follows[1:], [False]]))
        by_source: dict[int, dict[bytes, list]] = {}
        first, last = starts[heads], starts[tails] + window
        places = zip(at[heads].tolist(), doc[heads].tolist(), (first - chunk.begins[doc[heads]]).tolist())
        for (s, d, offset), i, j in zip(places, first.tolist(), last.tolist()):
            # Equal paths to one source are sent once, with all their places.
            by_source.setdefault(s, {}).setdefault(chunk.ids[i:j].tobytes(), []).append((d, offset))
        rows = []
        for s, paths in by_source.items():
            marks = [(i, d, offset) for i, places in enumerate(paths.values()) for d, offset in places]
            words = (b" ".join(map(chunk.held.__getitem__, np.frombuffer(p, np.int32).tolist())) for p in paths)
            rows.append((s, number, np.array(marks, np.int32).tobytes(), b"\n".join(words)))
        return table_of(rows, _PATHS)

    return run


def _prove(window: int):
    def run(table: pa.Table, paths: pa.Table) -> pa.Table:
        if not table.num_rows or not paths.num_rows:
            return table_of([], _SPANS)
        give_back()
        chunk = Chunk.of(table, window)
        chunk.index()
        edges, firsts = np.unique(chunk.prints, return_index=True)
        lookup = {w: i for i, w in enumerate(chunk.held)}.get
        rows = []
        if not len(edges):
            return table_of([], _SPANS)
        for sender, marks, words in zip(*(paths.column(c).to_pylist() for c in ("sender", "marks", "words"))):
            split = [p.split(b" ") for p in words.split(b"\n")]
            sizes = np.array([len(p) for p in split])
            ends = np.cumsum(sizes)
            flat = [w for p in split for w in p]
            ids = np.fromiter((lookup(w, -1) for w in flat), np.int32, len(flat))
            number = np.repeat(np.arange(len(split)), sizes)
            hashes = np.where(ids >= 0, chunk.word_hash[np.maximum(ids, 0)], np.uint64(0))
            prints = run_prints(hashes, window)
            whole = np.flatnonzero(number[: len(prints)] == number[window - 1 :][: len(prints)])
            edge = np.minimum(np.searchsorted(edges, prints[whole]), len(edges) - 1)
            source = chunk.starts[firsts[edge]]
            wide = np.arange(window)
            proven = np.concatenate(
                [
                    (ids[whole[i : i + 50_000, None] + wide] == chunk.ids[source[i : i + 50_000, None] + wide]).all(axis=1)
                    for i in range(0, len(whole), 50_000)
                ]
            )
            whole, source = whole[proven], source[proven]
            # Compact: the next edge here is also the next edge at the source.
            joined = np.zeros(len(whole), bool)
            joined[1:] = (
                (whole[1:] == whole[:-1] + 1)
                & (number[whole[1:]] == number[whole[:-1]])
                & (source[1:] == source[:-1] + 1)
                & (chunk.doc[source[1:]] == chunk.doc[source[:-1]])
            )
            heads = np.flatnonzero(~joined)
            length = np.diff(np.append(heads, len(whole))) + window - 1
            path = number[whole[heads]]
            offset = whole[heads] - (ends - sizes)[path]
            d = chunk.doc[source[heads]]
            spans = np.column_stack([offset, length, chunk.doc_ids[d], source[heads] - chunk.begins[d]])
            # Each place of a path gets the path's spans.
            places = np.frombuffer(marks, np.int32).reshape(-1, 3)
            from_ = np.searchsorted(path, places[:, 0], side="left")
            counts = np.searchsorted(path, places[:, 0], side="right") - from_
            pick = np.arange(int(counts.sum())) + np.repeat(from_ - (np.cumsum(counts) - counts), counts)
            found = spans[pick].astype(np.int64)
            found[:, 0] += np.repeat(places[:, 2], counts)
            rows.append((sender, np.column_stack([np.repeat(places[:, 1], counts), found]).astype("<i8").tobytes()))
        return table_of(rows, _SPANS)

    return run


_RESULT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,n_words:int,source_doc_id:bigint,source_start:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source_doc_id", pa.int64()), ("source_start", pa.int32())])


def _result(doc_ids: pa.Array, words: pa.Array, sizes: np.ndarray, spans: np.ndarray) -> pa.Table:
    """``spans``: place of the document, then as in ``_SPAN``, a row each."""
    spans = spans[np.lexsort(spans.T[::-1])]
    begins = np.cumsum(sizes) - sizes
    at = begins[spans[:, 0]] + spans[:, 1]
    gone = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + spans[:, 2], minlength=len(words) + 1)
    stays = np.cumsum(gone[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(stays)])
    kept = np.append(upto[begins], upto[-1])
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stays)))
    counts = np.bincount(spans[:, 0], minlength=len(sizes))
    found = pa.StructArray.from_arrays([pa.array(spans[:, i + 1], f.type) for i, f in enumerate(_SPAN)], fields=list(_SPAN))
    return pa.table(
        {
            "doc_id": doc_ids,
            "n_words": pa.array(sizes),
            "n_removed": pa.array(sizes - np.diff(kept)),
            "kept": pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
            "spans": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), found),
        }
    )


_NO_SPANS = np.empty((0, 5), np.int64)


def _take_out(window: int):
    def run(table: pa.Table, proven: pa.Table) -> pa.Table:
        chunk = Chunk.of(table, window)
        spans = [np.frombuffer(data, "<i8").reshape(-1, 5) for data in proven.column("spans").to_pylist()]
        return _result(pa.array(chunk.doc_ids, pa.int64()), chunk.words, chunk.sizes, np.concatenate([_NO_SPANS, *spans]))

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, path_bytes: int = PATH_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) per row of ``docs`` (doc_id, text): the words
    left, joined by one space, and the proven spans in words with their sources."""
    dealt, ranges = dealt_by_chunk(docs, chunk_bytes)
    n_buckets = max(1, math.ceil(len(ranges) / 2))
    edges = dealt.groupBy("chunk").applyInArrow(_send_edges(window, n_buckets), schema_of(_EDGES))
    answers = edges.groupBy("bucket").applyInArrow(_answer(ranges), schema_of(_REPEATED))
    by_chunk = dealt.groupBy("chunk")
    paths = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_cut_paths(window, n_buckets), schema_of(_PATHS))
    paths = paths.repartition(partitions(docs), "source")
    # A source of very many paths is copied, each copy with a part of the senders.
    # Reading every column (the senders' number is little beside the bytes) lets the sizes share
    # the exchange of the paths themselves.
    size = F.sum(F.length("words") + F.length("marks")) + F.max("sender")
    heavy = paths.groupBy("source").agg(F.ceil(size / path_bytes).cast("int").alias("copies")).filter("copies > 1")
    light = by_chunk.cogroup(paths.join(heavy, "source", "left_anti").groupBy("source"))
    part = F.expr("cast(pmod(xxhash64(sender), copies) as int) as part")
    shared = paths.join(heavy, "source").select("source", "sender", "marks", "words", part)
    copies = heavy.selectExpr("source as chunk", "explode(sequence(0, copies - 1)) as part")
    copied = dealt.join(copies, "chunk").select("chunk", "doc_id", "text", "part")
    proving = _prove(window), schema_of(_SPANS)
    spans = light.applyInArrow(*proving).unionByName(
        copied.groupBy("chunk", "part").cogroup(shared.groupBy("source", "part")).applyInArrow(*proving)
    )
    ordered = by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(_take_out(window), _RESULT)

    def keep_all(batches):
        for batch in slices(batches, "text", CHUNK_BYTES):
            words, sizes = split_words(batch.column("text"))
            yield from _result(pa.nulls(len(sizes), pa.int64()), words, sizes, _NO_SPANS).to_batches()

    unordered = docs.filter("doc_id is null").select("text").mapInArrow(keep_all, _RESULT)
    return ordered.unionByName(unordered)
