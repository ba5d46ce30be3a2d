"""N-gram Jaccard join with PartEnum signatures.

A document's set are its distinct shingles of ``words`` words. Sets are banded by size. Within a
band two sets that are similar enough differ in at most k elements. The element domain is cut
into n1 parts, so that some part of the two differs in one element at most; each part is cut into three,
and every two of these make a signature: one element can spoil one third only, so the two sets
share a signature. Sets near a band's lower end, seen from below, also join the next band.

No pair is missed, and none is expanded needlessly:

1. Documents are dealt into chunks; the texts are shuffled for this step and the next. Chunks send their distinct
   signatures, packed, to buckets, which tell which ones several chunks have, and the first chunk.
2. Each chunk links its own documents that share a signature, exactly. Of those that do, only sets
   with one of their rarest shingles in common are compared, and none that are connected already.
   What takes part further is written with its set, once.
3. Each chunk sends one document of each of its components to the first chunk of its
   signatures, if that is so for a fair part of them. Large groups of copies connect here by one
   document per chunk; links that this misses are found in the next step.
4. Signatures that still join several components: their documents' rarest shingles, so many that
   linked sets have a twentieth of a set in common there, are joined. Documents of the lighter component visit
   the chunks of the heavier one where they meet as many, and are compared with those not connected
   yet that share as many signatures with them as a link needs at least. Only sets of documents that meet as many are
   shuffled.
5. Components of the links give the result.

Every comparison is exact, on the whole sets. A chunk holds about ``chunk_bytes`` of text, and its
visitors are compared in parts of about ``visit_bytes``, each with a copy of it. Work beyond the input's size arises only from documents that share a signature without being similar.

A shingle counts by its 64-bit fingerprint. Words are runs of characters other than space and
``\\t`` to ``\\r``, A-Z lower-cased. Defined results: with fewer words than a shingle's, but some, the
whole sequence is the one shingle; without words or text the set is empty and links with
nothing. Rows of one doc_id count as one document with links of all. Rows without a doc_id link
with nothing and have no component. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsburst.llm.chunks import (
    CHUNK_BYTES,
    FACTOR,
    bucket_bounds,
    dealt_by_chunk,
    mix,
    packed,
    partitions,
    run_prints,
    schema_of,
    table_of,
    unpacked,
)
from newsburst.llm.common import drop_staged, free_shuffles, fresh, give_back, shuffles_end_with_jobs, slices, texts
from newsburst.operators.components import connected_components
from newsburst.session import stage

SPREAD = 1.5
#: Tables of at most so many short rows are broadcast, after they were counted.
BROADCAST_ROWS = 100_000
#: More bytes of visitors to one chunk than this are dealt to copies of it.
VISIT_BYTES = 32 << 20
#: Sets from which frequent shingles are counted, and at most so many of these.
SAMPLE, COMMON = 10_000, 65_536
#: Words are split, and sets' elements dealt to parts, so many bytes or elements at a time.
SLICE_BYTES, ELEMENTS = 1 << 20, 1 << 18
THIRDS = 3
#: The first round looks at documents with one in so many of their signatures in a chunk.
FAIR = 8
#: Prefixes have one in so many of a set's shingles more than linked sets need to meet at all, and must meet in as many.
EVIDENCE = 20


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``percent`` on shingles of ``words`` words."""

    words: int
    percent: int

    def linked(self, size_a: int, size_b: int, common: int) -> bool:
        return 100 * common >= self.percent * (size_a + size_b - common)

    def sizes_fit(self, size_a: int, size_b: int) -> bool:
        return 100 * min(size_a, size_b) >= self.percent * max(size_a, size_b)


@cache
def band(number: int, percent: int) -> tuple[int, int, int]:
    """Least and largest size of a band, and the most elements in which two linked sets differ."""
    low = 1 if number == 0 else band(number - 1, percent)[1] + 1
    # At least as wide that linked sets lie in one band or in neighbouring ones.
    high = max(int(low * SPREAD), 100 * low // percent)
    return low, high, (100 - percent) * 2 * high // (100 + percent)


@cache
def band_of(size: int, percent: int) -> int:
    number = 0
    while band(number, percent)[1] < size:
        number += 1
    return number


def spare(k: int) -> int:
    """Parts beyond those that k differences need."""
    return k // 16 + 2 if k else 0


@cache
def least_shared(size: int, percent: int) -> int:
    """How many signatures a set of this size shares at least with any that it links to: two
    sets of sizes s and t differ in at most so many elements that more parts stay nearly equal
    than the one that the band's bound leaves."""
    if not size:
        return 1
    number = band_of(size, percent)
    largest = 100 * size // percent
    needs = []
    for b, partner in ((number, min(largest, band(number, percent)[1])), (number + 1, largest)):
        k = band(b, percent)[2]
        differ = min(k, (100 - percent) * (size + partner) // (100 + percent))
        if b == number or 100 * size >= percent * band(b, percent)[0]:
            needs.append(k // 2 + 1 - differ // 2)
    return max(1, min(needs))


def set_of(words: list[int], hashes: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct shingle fingerprints of a document given as word numbers."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(run_prints(hashes[words], min(length, len(words))))


def _shares(items: list, limit: int):
    """The items in order, in lists of a summed length of about ``limit``; a longer one is a list of its own."""
    held, some = 0, []
    for item in items:
        if some and held + len(item) > limit:
            yield some
            held, some = 0, []
        held += len(item)
        some.append(item)
    if some:
        yield some


def _banded(sets: list[np.ndarray], places: dict[int, list[int]]):
    """(band, some of its sets, their numbers)"""
    for b, members in places.items():
        at = 0
        for some in _shares([sets[i] for i in members], ELEMENTS):
            yield b, some, members[at : at + len(some)]
            at += len(some)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) of all non-empty sets."""
    places: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            b = band_of(len(s), percent)
            places.setdefault(b, []).append(i)
            if 100 * len(s) >= percent * band(b + 1, percent)[0]:
                places.setdefault(b + 1, []).append(i)
    found, owners = [], []
    for b, some, members in _banded(sets, places):
        k = band(b, percent)[2]
        more = spare(k)
        n1 = k // 2 + 1 + more  # k differences: more + 1 parts at least have at most one
        thirds = THIRDS if k else 1
        cells = n1 * thirds
        sizes = np.array([len(x) for x in some])
        elements = mix(np.concatenate(some) ^ (FACTOR * np.array([b + 1], np.uint64)))
        part = (elements % np.uint64(n1)).astype(np.int64)
        third = ((elements >> np.uint64(40)) % np.uint64(thirds)).astype(np.int64)
        cell = np.repeat(np.arange(len(members)), sizes) * cells + part * thirds + third
        value = mix(elements)
        low = np.bincount(cell, weights=(value & np.uint64(0xFFFFFFFF)).astype(float), minlength=len(members) * cells)
        high = np.bincount(cell, weights=(value >> np.uint64(32)).astype(float), minlength=len(members) * cells)
        filled = (np.bincount(cell, minlength=len(members) * cells) > 0).reshape(len(members), n1, thirds)
        pairs = list(combinations(range(thirds), max(1, thirds - 1)))
        bare = sum(np.count_nonzero(~filled[:, :, list(chosen)].any(axis=2), axis=1) for chosen in pairs)
        # Sums of 32-bit halves stay exact in doubles; a cell's value hangs on its set of elements.
        held = mix(low.astype(np.uint64) + mix(high.astype(np.uint64))).reshape(len(members), n1, thirds)
        salt = mix(np.arange(n1, dtype=np.uint64) + np.uint64(b << 32))
        for chosen in pairs:
            mark = salt + np.uint64(chosen[0] * 8 + chosen[-1])
            total = mark[None, :] * FACTOR
            for t in chosen:
                total = mix(total + held[:, :, t] * FACTOR)
            made = filled[:, :, list(chosen)].any(axis=2) | (bare > more)[:, None]
            found.append(total[made])
            owners.append(np.repeat(np.array(members), made.sum(axis=1)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


class Links:
    """Union-find over documents of one task."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.above.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.above[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)


def similar(a: np.ndarray, b: np.ndarray, rule: Similarity) -> bool:
    if not rule.sizes_fit(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return rule.linked(len(a), len(b), int((b[at] == a).sum()))


@dataclass
class Classes:
    """Documents of a chunk in the order of doc_id, equal sets as one class."""

    rule: Similarity
    doc_ids: list[int]
    sets: list[np.ndarray]

    @classmethod
    def of(cls, table: pa.Table, rule: Similarity) -> Classes:
        rows = sorted(zip(table.column("doc_id").to_pylist(), texts(table.column("text").combine_chunks())))
        digest, sets = xxhash.xxh3_64_intdigest, []
        for some in _shares([t for _, t in rows], SLICE_BYTES):
            split = [t.lower().split() for t in some]  # bytes: only A-Z change
            flat = dict.fromkeys(w for words in split for w in words)
            number = {w: i for i, w in enumerate(flat)}
            hashes = np.array([digest(w) for w in flat], np.uint64)
            sets += [
                set_of(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), hashes, rule.words) for words in split
            ]
        return cls(rule, [d for d, _ in rows], sets)

    def __post_init__(self):
        by_set: dict[bytes, int] = {}
        # A class is named by the place of its first document.
        self.class_of = [by_set.setdefault(s.tobytes(), i) if len(s) else i for i, s in enumerate(self.sets)]
        firsts = [i for i, c in enumerate(self.class_of) if i == c]
        found, owner = signatures([self.sets[i] for i in firsts], self.rule.percent)
        owner = np.array(firsts, np.int64)[owner]
        order = np.lexsort((owner, found))
        self.signature, self.owner = found[order], owner[order]


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(sorted_values))


_SENT = [("bucket", pa.int32()), ("chunk", pa.int32()), ("signatures", pa.binary())]
_SHARED = [("chunk", pa.int32()), ("bucket", pa.int32()), ("places", pa.binary()), ("firsts", pa.binary())]


def _lean(step, *tables: pa.Table) -> pa.Table:
    """The step's result; what it held goes back at once, not when the worker's next group comes."""
    give_back()
    found = step(*tables)
    give_back()
    return found


def _send(rule: Similarity, n_buckets: int):
    bounds = bucket_bounds(n_buckets)

    def send(table: pa.Table) -> pa.Table:
        distinct = np.unique(Classes.of(table, rule).signature)
        number = table.column("chunk")[0].as_py()
        cuts = [0, *np.searchsorted(distinct, bounds).tolist(), len(distinct)]
        return table_of([(b, number, packed(distinct[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i], _SENT)

    def run(table: pa.Table) -> pa.Table:
        return _lean(send, table)

    return run


def _share(table: pa.Table) -> pa.Table:
    """For one bucket: which entries of each chunk several chunks have, and the first of these."""
    bucket = table.column("bucket")[0].as_py()
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("signatures").to_pylist()))
    lists = [unpacked(e, np.uint64) for _, e in rows]
    sizes = np.array([len(x) for x in lists])
    values = np.concatenate(lists)
    chunk = np.repeat(np.array([c for c, _ in rows], np.int32), sizes)
    order = np.argsort(values, kind="stable")
    starts, ends = _groups(values[order])
    held = np.repeat(ends - starts, ends - starts) > 1
    first = np.full(len(values), -1, np.int32)
    first[order[held]] = np.repeat(chunk[order[starts]], ends - starts)[held]
    result, at = [], 0
    for (number, _), size in zip(rows, sizes.tolist()):
        part = first[at : at + size]
        places = np.flatnonzero(part >= 0)
        if len(places):
            result.append((number, bucket, packed(places.astype(np.uint32)), part[places].tobytes()))
        at += size
    return table_of(result, _SHARED)


#: Every document with the root of its component within the chunk and the number of its signatures.
#: Only a class with signatures that other chunks have: its set, these signatures, the first chunk of each, and the chunks that
#: it visits for its component.
_LOCAL = (
    "chunk int, doc_id long, n long, root long, made int, elements binary, signatures array<long>, firsts array<int>, "
    "visits array<int>"
)
_LOCAL_ARROW = pa.schema(
    [
        ("chunk", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("made", pa.int32()),
        ("elements", pa.binary()), ("signatures", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())),
        ("visits", pa.list_(pa.int32())),
    ]
)


def reach(rest_a, rest_b, size_a, size_b, percent: int):
    """May two sets link whose first common shingle has so many behind it and itself in either?"""
    return np.minimum(rest_a, rest_b) * (100 + percent) >= percent * (size_a + size_b)


def _meeting(sets: list[np.ndarray], owners: np.ndarray, percent: int):
    """Groups of the named sets with one of their rarest shingles in common, each with the number of
    its shingles from there on: two that link meet, where they can still reach each other."""
    if not len(owners):
        return
    sizes = np.array([len(sets[i]) for i in owners])
    elements, number = np.unique(np.concatenate([sets[i] for i in owners]), return_inverse=True)
    count = np.bincount(number)[number]
    owner = np.repeat(owners, sizes)
    order = np.lexsort((number, count, owner))
    size = np.repeat(sizes, sizes)
    rest = size - (np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    wanted = (rest >= -(-percent * size // 100)) & (count[order] > 1)
    chosen, rest, size = order[wanted], rest[wanted], size[wanted]
    again = np.lexsort((owner[chosen], number[chosen]))
    chosen, rest, size = chosen[again], rest[again], size[again]
    for a, b in zip(*_groups(number[chosen])):
        kinds, kind = np.unique(np.stack([rest[a:b], size[a:b]]), axis=1, return_inverse=True)
        able = reach(kinds[0][:, None], kinds[0], kinds[1][:, None], kinds[1], percent).any(axis=1)[kind.ravel()]
        if np.count_nonzero(able) > 1:
            yield owner[chosen[a:b]][able].tolist(), rest[a:b][able].tolist()


def _link_within(rule: Similarity, n_buckets: int):
    bounds = bucket_bounds(n_buckets)

    def link(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _LOCAL_ARROW.empty_table()
        classes = Classes.of(table, rule)
        number = table.column("chunk")[0].as_py()
        ids, sets = classes.doc_ids, classes.sets
        links, compared = Links(), set()
        for i, c in enumerate(classes.class_of):
            links.join(i, c)
        for a, b in zip(range(len(ids)), range(1, len(ids))):
            if ids[a] == ids[b]:
                links.join(a, b)
        starts, ends = _groups(classes.signature)
        many = np.repeat(ends - starts > 1, ends - starts)
        for members, rests in _meeting(sets, np.unique(classes.owner[many]), rule.percent):
            met: dict[int, list[int]] = {}
            rest = dict(zip(members, rests))
            for b in members:
                for root, others in list(met.items()):
                    if links.root(b) == links.root(others[0]):
                        continue
                    for a in others:
                        able = reach(rest[a], rest[b], len(sets[a]), len(sets[b]), rule.percent)
                        if able and (a, b) not in compared:
                            compared.add((a, b))
                            if similar(sets[a], sets[b], rule):
                                links.join(a, b)
                                break
                home = met.setdefault(links.root(b), [])
                for root in [r for r in met if r != links.root(b) and links.root(r) == links.root(b)]:
                    home += met.pop(root)
                home.append(b)
        # Places in the buckets' answers are places among the distinct signatures.
        distinct = classes.signature[starts] if len(starts) else classes.signature
        base = [0, *np.searchsorted(distinct, bounds).tolist()]
        first = np.full(len(distinct), -1, np.int32)
        for b, places, firsts in zip(*(shared.column(c).to_pylist() for c in ("bucket", "places", "firsts"))):
            first[base[b] + unpacked(places, np.uint32)] = np.frombuffer(firsts, np.int32)
        each = np.repeat(first, ends - starts)
        outer = np.flatnonzero(each >= 0)
        outer = outer[np.argsort(classes.owner[outer], kind="stable")]
        begin, end = _groups(classes.owner[outer])
        abroad = {int(classes.owner[outer[a]]): outer[a:b] for a, b in zip(begin, end)}
        made = np.bincount(classes.owner, minlength=len(ids)).tolist()
        # Of each component the class with most signatures that came up there first visits a chunk.
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i, mine in abroad.items():
            for c, count in zip(*(x.tolist() for x in np.unique(each[mine], return_counts=True))):
                if c != number and FAIR * count >= made[i]:
                    key = (links.root(i), c)
                    best[key] = max(best.get(key, (0, 0)), (count, -i))
        visits: dict[int, list[int]] = {}
        for (_, c), (_, i) in sorted(best.items()):
            visits.setdefault(-i, []).append(c)
        rows = []
        for i, d in enumerate(ids):
            mine = abroad.get(i)
            extra = (
                (None, None, None, None)
                if mine is None
                else (
                    sets[i].tobytes(), classes.signature[mine].view(np.int64).tolist(), each[mine].tolist(),
                    visits.get(i, []),
                )
            )
            rows.append((number, d, len(sets[i]), ids[links.root(i)], made[i], *extra))
        columns = list(zip(*rows))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LOCAL_ARROW)], schema=_LOCAL_ARROW)

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        return _lean(link, table, shared)

    return run


def _compare(rule: Similarity, group_key: str, whole: bool = False):
    """Links between visiting documents and a chunk's own that share a signature: as many as
    connect each visitor with every component it links to. With ``whole`` lists of signatures, two
    rows are compared only if they share as many as the sizes of linked sets need."""

    def compare(own: pa.Table, visitors: pa.Table) -> pa.Table:
        pairs: list[tuple[int, int]] = []
        if own.num_rows and visitors.num_rows:
            groups, home_sets, sizes, held = _lists(own, group_key)
            order = np.argsort(held, kind="stable")
            held, owner = held[order], np.repeat(np.arange(len(groups)), sizes)[order]
            least = [least_shared(len(x), rule.percent) if whole else 1 for x in home_sets]
            for group, mine, signed in zip(*_lists(visitors, group_key, split=True)):
                need = least_shared(len(mine), rule.percent) if whole else 1
                reached = {group}
                starts = np.searchsorted(held, signed)
                counts = np.searchsorted(held, signed, side="right") - starts
                places = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                for i, shared in zip(*(x.tolist() for x in np.unique(owner[places], return_counts=True))):
                    if shared < max(need, least[i]) or groups[i] in reached:
                        continue
                    if similar(mine, home_sets[i], rule):
                        reached.add(groups[i])
                        pairs.append((group, groups[i]))
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    def run(own: pa.Table, visitors: pa.Table) -> pa.Table:
        return _lean(compare, own, visitors)

    return run


def _lists(rows: pa.Table, group_key: str, split: bool = False):
    """Groups, sets, and the rows' signatures: their numbers and all in one array, or ``split`` by row. Sets and
    signatures are views of the table, not Python objects."""
    groups, sets, numbers, flat = [], [], [], [np.empty(0, np.int64)]
    for batch in rows.select([group_key, "elements", "signatures"]).to_batches():
        groups += batch.column(0).to_pylist()
        sets += [np.frombuffer(e.as_buffer(), np.uint64) for e in batch.column(1)]
        numbers += batch.column(2).value_lengths().to_pylist()
        flat.append(batch.column(2).flatten().to_numpy(zero_copy_only=False))
    flat = np.concatenate(flat)
    if not split:
        return groups, sets, numbers, flat
    return groups, sets, np.split(flat, np.cumsum(numbers)[:-1])


def _meet(own: DataFrame, visits: DataFrame, group: str, compare, visit_bytes: int) -> DataFrame:
    """Links (a, b) of the visits (home, chunk, n, group, elements, signatures) with the homes' own
    documents. The visitors of one home are dealt into parts of about ``visit_bytes``, each of
    which meets a copy of the home."""
    size = F.sum(8 * (F.col("n") + F.size("signatures")))
    copies = visits.groupBy("home").agg(F.ceil(size / visit_bytes).cast("int").alias("copies"))
    heavy, small = _counted(copies.filter("copies > 1"), "copies")
    each = F.expr("explode(sequence(0, coalesce(copies, 1) - 1))").alias("part")
    own = own.join(small(heavy.select(*_again("home", "copies"))), F.col("chunk") == F.col("home"), "left")
    own = own.select("chunk", each, group, "elements", "signatures")
    part = F.expr("cast(coalesce(pmod(xxhash64(chunk, elements), copies), 0) as int)").alias("part")
    visits = visits.join(small(heavy), "home", "left").select("home", part, group, "elements", "signatures")
    met = own.groupBy("chunk", "part").cogroup(visits.groupBy("home", "part"))
    return stage(met.applyInArrow(compare, "a long, b long"), "links")


def _counted(rows: DataFrame, name: str):
    """The rows, written, and a hint: broadcast when few of them were counted, else none."""
    rows = stage(rows, name)
    few = rows.count() <= BROADCAST_ROWS
    return rows, F.broadcast if few else (lambda df: df)


def _again(*names: str) -> list:
    """The columns under new identities, to meet those of the table they come from."""
    return [F.col(n).alias(n) for n in names]


def _components(links: DataFrame) -> DataFrame:
    """(root, component): smallest root reachable."""
    edges = links.select(F.lit(0).cast("long").alias("scope"), "a", "b")
    found = connected_components(edges, ["scope"])
    return found.select(F.col("id").alias("node"), F.col("root").alias("component"))


def _linked_within_chunks(docs: DataFrame, rule: Similarity, chunk_bytes: int) -> DataFrame:
    dealt, ranges = dealt_by_chunk(docs, chunk_bytes)
    n_buckets = max(1, math.ceil(len(ranges) / 2))
    by_chunk = dealt.groupBy("chunk")
    sent = by_chunk.applyInArrow(_send(rule, n_buckets), schema_of(_SENT))
    # Written first: the signatures that were sent are gone before the sets are written. Texts are shuffled again.
    shared = stage(sent.groupBy("bucket").applyInArrow(_share, schema_of(_SHARED)), "shared")
    free_shuffles(docs.sparkSession)
    return stage(by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_link_within(rule, n_buckets), _LOCAL), "local")


def _first_round(active: DataFrame, rule: Similarity, visit_bytes: int) -> DataFrame:
    """Links of one document of each component with the first chunk of its signatures."""
    here = "transform(filter(arrays_zip(signatures, firsts), s -> s.firsts = {}), s -> s.signatures) as signatures"
    own = active.selectExpr("chunk", "root", "made", "elements", here.format("chunk"))
    own = own.filter(f"size(signatures) > 0 and {FAIR} * size(signatures) >= made")
    visits = active.selectExpr("chunk", "n", "root", "elements", "signatures", "firsts", "explode(visits) as home")
    visits = visits.selectExpr("home", "chunk", "n", "root", "elements", here.format("home"))
    visits = visits.select(*_again("home", "chunk", "n", "root", "elements", "signatures"))
    return _meet(own, visits, "root", _compare(rule, "root"), visit_bytes)


def _opened(active: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, group, weight) of the documents with a signature that still joins several components; weight is the
    number of a component's documents here."""
    found, small = _counted(_components(links), "components")
    narrow = active.drop("made", "elements", "firsts", "visits").join(small(found), active.root == found.node, "left")
    members = narrow.select("doc_id", F.coalesce("component", "root").alias("group"), F.explode("signatures").alias("signature"))
    span = members.groupBy("signature").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    several, small = _counted(span.filter("low < high").select("signature"), "several")
    met = stage(members.join(small(several), "signature").select("doc_id", "group").distinct(), "met")
    free_shuffles(active.sparkSession)
    weights, small = _counted(met.groupBy("group").agg(F.count("*").alias("weight")), "weights")
    return stage(met.join(small(weights), "group").select("doc_id", "group", "weight"), "opened")


def _common(active: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints that are most frequent in a sample of the sets, and their counts. They
    only order the shingles: any order gives the same links, this one few visits."""
    every = max(1, math.ceil(active.count() / SAMPLE))
    sampled = active.filter(F.pmod(F.xxhash64("chunk", "doc_id"), F.lit(every)) == 0).select("elements")

    def count(batches):
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            values, counts = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["element", "held"])

    counted = sampled.mapInArrow(count, "element long, held long").groupBy("element").agg(F.sum("held").alias("held"))
    rows = counted.filter("held > 1").orderBy(F.desc("held"), "element").limit(COMMON).collect()
    values = np.array([r.element for r in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r.held for r in rows], np.int64)[order]


def met_least(size: int, percent: int) -> int:
    """Two linked sets share at least the smaller one's number of these among the rarest shingles that ``prefix``
    takes: the k-th of their common shingles has all others, but k, behind it in either set."""
    return min(1 + size // EVIDENCE, -(-percent * size // 100))


def prefix(elements: np.ndarray, common: np.ndarray, held: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, so many that two linked sets have ``met_least`` of them in common: a
    linked set lacks at most 100 - percent in a hundred of them."""
    count = np.zeros(len(elements), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
        count = np.where(common[at] == elements, held[at], 0)
    size = len(elements) - -(-percent * len(elements) // 100) + met_least(len(elements), percent)
    return elements[np.lexsort((elements, count))[:size]]


def _prefixes(active: DataFrame, rule: Similarity) -> DataFrame:
    """(element, rest, chunk, doc_id, n) of the prefixes of the sets, made where these lie: no set is shuffled; rest is
    the number of shingles from there on."""
    common, held = _common(active)
    free_shuffles(active.sparkSession)
    names = ["chunk", "doc_id", "n"]

    def cut(batches):
        give_back()
        for batch in batches:
            found = [
                prefix(np.frombuffer(e, np.uint64), common, held, rule.percent) for e in batch.column("elements").to_pylist()
            ]
            each = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            element = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            sizes = batch.column("n").to_numpy()
            rest = np.concatenate([np.empty(0, np.int64), *(n - np.arange(len(f)) for n, f in zip(sizes, found))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(element), pa.array(rest), *(batch.column(c).take(each) for c in names)],
                ["element", "rest", *names],
            )

    rows = active.select(*names, "elements")
    return stage(rows.mapInArrow(cut, "element long, rest long, chunk int, doc_id long, n long"), "prefixes")


def _met_elsewhere(keys: DataFrame) -> DataFrame:
    """The keys whose element several chunks have. Most rarest shingles are in one document only: these are left
    out by counting, before a join shuffles whole keys."""
    spans = keys.groupBy("element").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    shared, small = _counted(spans.filter("low < high").select("element"), "shared")
    free_shuffles(keys.sparkSession)
    return stage(keys.join(small(shared), "element", "left_semi"), "meeting")


def _candidates(keys: DataFrame, rule: Similarity) -> DataFrame:
    """(home, doc_id, visits): the documents that have in common with the prefixes in another chunk as many shingles as
    a link needs, each with a set of a fitting size and another component. Those of the lighter component visit."""
    homes = keys.groupBy("element", F.col("chunk").alias("home")).agg(
        F.max(F.struct("weight", "group")).alias("heaviest"), F.min(F.struct("weight", "group")).alias("lightest"),
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("room"),
    )
    mine = F.struct("weight", "group")
    other = (F.col("home") != F.col("chunk")) & ((mine != F.col("heaviest")) | (mine != F.col("lightest")))
    fits = (F.col("low") * rule.percent <= F.col("n") * 100) & (F.col("high") * 100 >= F.col("n") * rule.percent)
    able = F.least("rest", "room") * (100 + rule.percent) >= (F.col("n") + F.col("low")) * rule.percent
    smallest = f"((n * {rule.percent} + 99) div 100)"  # of the sets it may link to
    need = F.expr(f"least(1 + {smallest} div {EVIDENCE}, ({smallest} * {rule.percent} + 99) div 100)")
    met = keys.join(homes, "element").filter(other & fits)
    met = met.select("home", "doc_id", need.alias("need"), able.alias("able"), (able & (mine < F.col("heaviest"))).alias("visits"))
    counted = met.groupBy("home", "doc_id").agg(
        F.count("*").alias("shared"), F.min("need").alias("need"), F.bool_or("able").alias("able"), F.bool_or("visits").alias("visits")
    )
    return counted.filter("able and shared >= need").select("home", "doc_id", "visits")


def _second_round(active: DataFrame, opened: DataFrame, rule: Similarity, visit_bytes: int) -> DataFrame:
    """Links between components that still share signatures. Only documents that meet enough of another chunk's
    shingles are shuffled with their sets."""
    spark = active.sparkSession
    prefixes = _prefixes(active, rule)
    meeting = _met_elsewhere(prefixes)
    drop_staged(prefixes)
    free_shuffles(spark)
    few = F.broadcast if opened.count() <= BROADCAST_ROWS else (lambda df: df)
    keys = stage(meeting.join(few(opened), "doc_id"), "keys")
    drop_staged(meeting)
    free_shuffles(spark)
    found = stage(_candidates(keys, rule), "candidates")
    drop_staged(keys)
    free_shuffles(spark)
    ids, small = _counted(found.select("doc_id").distinct().join(opened, "doc_id").select("doc_id", "group"), "taking")
    rows = active.select("chunk", "doc_id", "n", "elements", "signatures").join(small(ids), "doc_id")
    rows = stage(rows, "sets")
    drop_staged(active, opened)
    free_shuffles(spark)
    routes, small = _counted(found.filter("visits").select("home", "doc_id"), "routes")
    visits = rows.join(small(routes), "doc_id").select("home", *_again("chunk", "n", "group", "elements", "signatures"))
    links = _meet(rows, visits, "group", _compare(rule, "group", whole=True), visit_bytes)
    drop_staged(rows)
    return links


def _near(docs: DataFrame, rule: Similarity, chunk_bytes: int, visit_bytes: int) -> DataFrame:
    # Each step ends in a written table; what it shuffled, and tables with sets that nothing reads any more, go
    # before the next one.
    spark = docs.sparkSession
    with shuffles_end_with_jobs(spark):
        local = _linked_within_chunks(docs, rule, chunk_bytes)
        free_shuffles(spark)
        roots = stage(local.select("doc_id", "n", "root"), "roots")
        active = local.filter("signatures is not null")
        links = _first_round(active, rule, visit_bytes)
        free_shuffles(spark)
        opened = _opened(active, links)
        free_shuffles(spark)
        more = _second_round(active, opened, rule, visit_bytes)
        free_shuffles(spark)
        # Links of the second round name components: their smallest roots, which are nodes as well.
        final = _components(stage(links.unionByName(more), "links"))
    return roots.join(final, roots.root == final.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "root").alias("component_id")
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, chunk_bytes: int = CHUNK_BYTES, visit_bytes: int = VISIT_BYTES
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text): component_id is the
    smallest doc_id reached over links of at least ``percent`` Jaccard similarity."""
    rule = Similarity(words, percent)

    def count_only(batches):
        for batch in slices(batches, "text", chunk_bytes):
            found = []
            for t in texts(batch.column("text")):
                listed = t.lower().split()
                length = min(words, len(listed))
                found.append(len({tuple(listed[i : i + length]) for i in range(len(listed) - length + 1)}) if listed else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(found), pa.int64()), pa.array(found, pa.int64()), pa.nulls(len(found), pa.int64())],
                ["doc_id", "n_shingles", "component_id"],
            )

    unnamed = docs.filter("doc_id is null").select("text")
    return _near(docs, rule, chunk_bytes, visit_bytes).unionByName(
        unnamed.mapInArrow(count_only, "doc_id long, n_shingles long, component_id long")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: of its smallest doc_id, the one of the smallest
    text. Rows without a doc_id stay."""
    known = docs.filter("doc_id is not null")
    first = near_duplicates(known.select("doc_id", "text"), **options).filter("doc_id = component_id")
    kept = known.join(first.select("doc_id").distinct(), "doc_id", "left_semi").select(*(f"`{c}`" for c in docs.columns))
    place = fresh(docs, "_place")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = kept.withColumn(place, order).filter(F.col(place) == 1).drop(place)
    return kept.unionByName(docs.filter("doc_id is null"))
