"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a bounded slice of documents inside a task. Words that occur in no benchmark item
cannot be part of a match, so a shard's array holds the suffixes of its runs of benchmark words
only; this leaves out nothing that could match. Every suffix of every benchmark item is looked
up by binary search; each place found is extended to the longest verbatim match there.

Documents stay where they are: no shuffle. The benchmark goes to the tasks in blocks of about
``block_bytes`` of text, one pass of the documents each, so what is sent at once is bounded.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII characters.
A match has at least ``window`` words, or is the whole of an item with fewer.

Defined results: null or wordless documents have no matches; null or wordless items match
nothing; items of equal text all match, as do equal documents; an item_id given twice counts
once per match in the list of items. Empty tables give no matches. Columns of the documents pass
through unchanged, whatever their names.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsburst.llm.common import fresh, slices, texts

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_start", T.IntegerType()),
        T.StructField("doc_start", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` tokens, by doubling."""
    rank = tokens.astype(np.int64)
    span = 1
    while span < depth and len(rank):
        following = np.zeros_like(rank)
        following[:-span] = rank[span:] if span < len(rank) else 0
        pair = rank * (int(rank.max()) + 1) + following
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        rank += 1
        span *= 2
    return np.argsort(rank, kind="stable")


class TestSuffixes:
    """One block of benchmark items as token rows, ready to be searched for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.names = [name for name, _ in items]
        coded = [np.array([number(w, len(self.vocabulary) + 1) for w in words], np.int32) for _, words in items]
        self.longest = max((len(c) for c in coded), default=0)
        needs = [min(window, len(c)) for c in coded]
        self.least = min(needs, default=1)
        # A suffix is searched by its first `need` words; starts too late to hold them are parts of others.
        self.item = np.concatenate(
            [np.full(len(c) - n + 1, i, np.int32) for i, (c, n) in enumerate(zip(coded, needs))] or [np.empty(0, np.int32)]
        )
        self.start = np.concatenate(
            [np.arange(len(c) - n + 1, dtype=np.int32) for c, n in zip(coded, needs)] or [np.empty(0, np.int32)]
        )
        self.need = np.array(needs, np.int32)[self.item]
        padded = [np.concatenate([[-1], c, np.full(window, -1)]).astype(np.int32) for c in coded]
        self.flat = np.concatenate(padded or [np.empty(0, np.int32)])
        self.base = np.concatenate([[0], np.cumsum([len(p) for p in padded])]).astype(np.int64)[self.item] + 1

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix number, place, length) of all left-maximal matches in ``tokens`` (0: no word
        of this block; the last ``longest`` tokens must be 0)."""
        order = suffix_array(tokens, self.window)
        at = self.base + self.start
        wide = np.arange(self.window)
        wanted = self.flat[at[:, None] + wide]
        unused = wide >= self.need[:, None]

        def bound(past_equal: bool) -> np.ndarray:
            low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                places = order[np.minimum(middle, len(order) - 1)]
                have = tokens[np.minimum(places[:, None] + wide, len(tokens) - 1)]
                differs = (have != wanted) & ~unused
                first = differs.argmax(axis=1)
                rows = np.arange(len(at))
                smaller = differs.any(axis=1) & (have[rows, first] < wanted[rows, first])
                if past_equal:
                    smaller |= ~differs.any(axis=1)
                low = np.where(open_ & smaller, middle + 1, low)
                high = np.where(open_ & ~smaller, middle, high)
            return low

        from_, to = bound(False), bound(True)
        counts = to - from_
        suffix = np.repeat(np.arange(len(at)), counts)
        offset = np.arange(len(suffix)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = order[np.repeat(from_, counts) + offset]
        # What the suffix one word earlier finds one word earlier holds this match.
        before = np.where(place > 0, tokens[place - 1], 0)
        maximal = before != self.flat[at[suffix] - 1]
        suffix, place = suffix[maximal], place[maximal]
        length = self.need[suffix].astype(np.int64)
        growing = np.arange(len(suffix))
        while len(growing):
            here, item = place[growing] + length[growing], at[suffix[growing]] + length[growing]
            growing = growing[tokens[here] == self.flat[item]]
            length[growing] += 1
        return suffix, place, length


def _search(split: list[list[bytes]], tests: TestSuffixes) -> list[list[tuple]]:
    """The matches of each of a shard's documents, given as words."""
    get = tests.vocabulary.get
    ends = np.cumsum([len(w) + 1 for w in split])
    tokens = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for words, end in zip(split, ends):
        tokens[end - 1 - len(words) : end - 1] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
    found: list[list[tuple]] = [[] for _ in split]
    # Runs of benchmark words long enough to hold a match, one after another, a 0 behind each.
    known = np.concatenate([[0], (tokens != 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known)).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= tests.least]
    if not len(edges) or not len(tests.item):
        return found
    sizes = edges[:, 1] - edges[:, 0] + 1
    firsts = np.cumsum(sizes) - sizes
    origin = np.arange(int(sizes.sum())) + np.repeat(edges[:, 0] - firsts, sizes)
    dense = np.concatenate([tokens[origin], np.zeros(tests.longest + tests.window, np.int32)])
    suffix, place, length = tests.find(dense)
    places = origin[place]
    documents = np.searchsorted(ends, places, side="right")
    starts = places - np.concatenate([[0], ends])[documents]
    for s, d, at, n in zip(suffix.tolist(), documents.tolist(), starts.tolist(), length.tolist()):
        found[d].append((tests.names[tests.item[s]], int(tests.start[s]), at, n))
    return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> int:
    held = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(held / block_bytes))


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    column: str,
    keep: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``column`` added: (n_words, matches) of its text, the matches being the
    maximal verbatim ones with benchmark items (item_id, text), as (item_id, item_start,
    doc_start, n_words) in words. ``keep``: the columns of ``docs`` to return, by default all."""
    n_blocks = _blocks(benchmark, block_bytes)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    given = [f for f in docs.schema.fields if keep is None or f.name in keep]
    result = docs.withColumn(column, F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast(T.ArrayType(MATCH)).alias("matches")))
    for number in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == number)
        worded = [(r.item_id, words_of(r.text.encode())) for r in block.collect()]
        tests = TestSuffixes([(name, words) for name, words in worded if words], window)
        fields = given if number == n_blocks - 1 else docs.schema.fields
        names = [f.name for f in fields]

        def search(batches, tests=tests, names=names):
            for batch in slices(batches, "text", SHARD_BYTES):
                split = [words_of(t) for t in texts(batch.column("text"))]
                found = _search(split, tests)
                old = batch.column(column).field("matches").to_pylist()
                rows = [
                    {"n_words": len(w), "matches": a + [dict(zip(MATCH.names, m)) for m in b]}
                    for w, a, b in zip(split, old, found)
                ]
                kind = batch.schema.field(column)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names), pa.array(rows, kind.type)],
                    schema=pa.schema([*(batch.schema.field(n) for n in names), kind]),
                )

        result = result.mapInArrow(search, T.StructType([*fields, result.schema[column]]))
    return result


def hit_words(matches: Column) -> Column:
    """Number of words inside at least one match."""
    spans = F.array_sort(
        F.transform(matches, lambda m: F.struct(m.doc_start.alias("a"), (m.doc_start + m.n_words).alias("b")))
    )
    zero = F.struct(F.lit(0).alias("reached"), F.lit(0).cast("long").alias("n"))

    def add(state, span):
        fresh_words = F.greatest(F.lit(0), span.b - F.greatest(state.reached, span.a))
        return F.struct(F.greatest(state.reached, span.b).alias("reached"), (state.n + fresh_words).alias("n"))

    return F.aggregate(spans, zero, add, lambda s: s.n)


def hit_items(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.item_id)))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, matches, longest) per document: every match, and the words of the longest."""
    found = find_matches(docs.select("doc_id", "text"), benchmark, "found", keep=["doc_id"], **options)
    longest = F.coalesce(F.array_max(F.transform("found.matches", lambda m: m.n_words)), F.lit(0))
    return found.select("doc_id", "found.n_words", "found.matches", longest.alias("longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a match."""
    column = fresh(docs, "_found")
    return find_matches(docs, benchmark, column, **options).filter(F.size(f"{column}.matches") == 0).drop(column)
