"""Prefix trie of conversations, built by van Emde Boas recursion.

All sequences are cut at half of the depth. What lies above the cut is named, and each distinct name
stands once, for its smallest conversation, in the upper trie; what lies below hangs under that
name, in a forest of lower tries. Upper and lower halves are cut again in the same way, all problems
of one size in one Spark job, so a trie of depth D takes log2(D) rounds:

1. Blocks of 2, 4, 8, ... turns of each conversation get digests, two blocks at a time.
2. A round joins every sequence with the digest of its upper half, which with the name of its root names the
   cut prefix: a node with its members and its smallest one. Equal upper halves go on as one sequence; lower
   halves go on under the new name. At depth one, root and end of a sequence are a node's parent and the node.
3. Totals are grafted upward in rounds of 1, 2, 4, ...: what the lower tries of a cut prefix sum up
   to is added to it and to its ancestors in the upper trie.

No conversation is gathered in one task, nor the members of a node: its counts are partial sums, the
ids of conversations that end there are joined from sorted ranges, piece by piece. Names are 128-bit
digests. Rows of rounds: at most one for each turn and round; grafting adds at most as many.

Defined results: null roles and texts are empty. A sequence without turns is a member of the root. Rows
without conv_id are left out. Turns of equal number follow by role, then digest of role and text. No
conversations, no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsburst.session import stage

#: Tables of at most so many rows are broadcast, after they were counted.
BROADCAST_ROWS = 100_000
#: Bytes of joined ids that a row holds.
PIECE_BYTES = 1 << 20
ROOT = "root"


def _digest(*parts) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _name_of_root() -> Column:
    return F.unhex(F.md5(F.lit(ROOT)))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, symbol, chars) of ``turns`` (conv_id, turn, role, text): place from 0 in the order of
    turns, a digest for role and text, code points of the text.

    Rows are sorted in ranges, which may cut a conversation; a place is that in the range and what
    the conversation has in the ranges before.
    """
    role, text = (F.coalesce(f"`{c}`", F.lit("")) for c in ("role", "text"))
    symbol = _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter("`conv_id` is not null").select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.col("`turn`").cast("long").alias("turn"),
        role.alias("role"),
        symbol.alias("symbol"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "symbol"]
    ranged = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = stage(ranged.select("conv_id", "turn", "role", "symbol", "chars", "range"), "turns")
    # Ranges hold whole runs of equal turns, so the order of ranges is that of the turns.
    held = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("conv_id", "range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "range").orderBy(*order[1:])
    placed = ranged.withColumn("at", F.row_number().over(inside) - 1)
    return placed.join(before, ["conv_id", "range"]).select(
        "conv_id", (F.col("before") + F.col("at")).alias("place"), "symbol", "chars"
    )


def _blocks(sequences: DataFrame, depth: int) -> list[DataFrame]:
    """(conv_id, block, digest) of whole blocks of 1, 2, 4, ... turns, up to the depth: the whole problem is
    longer, so that every node lies at a cut."""
    blocks = [sequences.select("conv_id", F.col("place").alias("block"), F.col("symbol").alias("digest"))]
    while 1 << len(blocks) <= depth:
        half = F.col("block") % 2 == 0
        pairs = blocks[-1].groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(
            F.max(F.when(half, F.col("digest"))).alias("head"), F.max(F.when(~half, F.col("digest"))).alias("tail")
        )
        whole = pairs.filter("head is not null and tail is not null")
        blocks.append(stage(whole.select("conv_id", "block", _digest("head", "tail").alias("digest")), "blocks"))
    return blocks


def _cut(open_: DataFrame, blocks: DataFrame, half: int) -> DataFrame:
    """One round: every open sequence (conv_id, above, root, end, members, length) with the name of its upper
    half, null where it ends above."""
    at = (F.col("above") / half).cast("long")
    found = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "digest")
    reached = F.col("length") >= F.col("above") + half
    met = open_.join(found, (open_.conv_id == F.col("_conv")) & (at == F.col("_block")) & reached, "left")
    return met.select(*open_.columns, F.when(reached, _digest("root", "digest")).alias("cut"))


def _halves(cut: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """(nodes named by a round, sequences that are open behind it)."""
    named = cut.filter("cut is not null")
    nodes = named.groupBy(F.col("cut").alias("name")).agg(
        F.max("root").alias("root"), (F.max("above") + half).alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("members").alias("n_convs"),
    )
    upper = nodes.select(
        "conv_id", (F.col("depth") - half).alias("above"), "root", F.col("name").alias("end"),
        F.col("n_convs").alias("members"), F.col("depth").alias("length"),
    )
    lower = named.filter(F.col("length") > F.col("above") + half).select(
        "conv_id", (F.col("above") + half).alias("above"), F.col("cut").alias("root"), "end", "members", "length"
    )
    short = cut.filter("cut is null and length > above").drop("cut")
    return nodes.drop("root"), upper.unionByName(lower).unionByName(short)


def _joined_ids(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of all nodes at which conversations (name, conv_id) end."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, held, size = None, 0, [], 0

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])],
                ["name", "first", "ids"],
            )

        for batch in batches:
            for n, c in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (n != name or size >= PIECE_BYTES):
                    yield piece()
                    held, size = [], 0
                if not held:
                    name, first = n, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([sha.hexdigest()])], ["name", "ends_sha256"]
            )

        for batch in batches:
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if n != name:
                    if sha is not None:
                        yield row()
                    name, sha = n, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if sha is not None:
            yield row()

    ordered = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    joined = ordered.mapInArrow(pieces, "name binary, first long, ids string")
    dealt = joined.repartition("name").sortWithinPartitions("name", "first")
    return dealt.mapInArrow(digests, "name binary, ends_sha256 string")


def _grafted(nodes: DataFrame, depth: int) -> DataFrame:
    """(name, n_leaves, saved_tokens) summed over the subtrees of ``nodes`` (name, parent, depth, n_leaves,
    saved_tokens: their own) below the root."""
    totals = nodes.filter("depth > 0").select("name", "parent", "depth", "n_leaves", "saved_tokens")
    # Each node at a multiple of the half with its ancestors down from the multiple before it, itself
    # among them; the row of itself holds the ancestor at that multiple.
    lines = totals.select("name", "depth", F.col("parent").alias("up"), F.col("name").alias("ancestor"))
    half = 1
    while half < depth:
        lower = totals.filter((F.col("depth") - 1) % (2 * half) == half)
        grafts = lower.groupBy(F.col("parent").alias("cut")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
        )
        added = lines.filter(F.col("depth") % (2 * half) == half).join(grafts, F.col("name") == F.col("cut"))
        added = added.select(
            F.col("ancestor").alias("name"), F.lit(None).cast("binary").alias("parent"),
            F.lit(None).cast("long").alias("depth"), "n_leaves", "saved_tokens",
        )
        totals = totals.unionByName(added).groupBy("name").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
        )
        totals = stage(totals, "totals")
        half *= 2
        if half < depth:
            lines = stage(_longer(lines, half), "lines")
    return totals


def _longer(lines: DataFrame, half: int) -> DataFrame:
    """Lines of ``half`` ancestors from those of half as many."""
    kept = lines.filter(F.col("depth") % half == 0)
    own = F.col("ancestor") == F.col("name")
    heads = kept.filter(own).select(F.col("name").alias("low"), F.col("depth").alias("at"), F.col("up").alias("via"))
    above = lines.select("name", "up", "ancestor")
    met = heads.join(above, F.col("via") == F.col("name"))
    nothing = F.lit(None).cast("binary").alias("up")
    further = met.select(F.col("low").alias("name"), F.col("at").alias("depth"), nothing, "ancestor")
    itself = met.filter(own).select(F.col("low").alias("name"), F.col("at").alias("depth"), "up", F.col("low").alias("ancestor"))
    return further.unionByName(itself).unionByName(kept.filter(~own))


def prefix_trie(sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, place, symbol, chars), with places from 0
    without gaps, over all ``conversations`` (conv_id), also those without a turn: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sequences = stage(sequences.select("conv_id", "place", "symbol", "chars"), "sequences")
    lengths = sequences.groupBy("conv_id").agg(F.count("*").alias("length"))
    ids = conversations.select("conv_id").filter("conv_id is not null").distinct()
    lengths = stage(ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length")), "lengths")
    n, low, depth = lengths.agg(F.count("*"), F.min("conv_id"), F.max("length")).first()
    depth = depth or 0
    nobody = F.lit(None).cast("binary")
    open_ = lengths.filter("length > 0").select(
        "conv_id", F.lit(0).cast("long").alias("above"), _name_of_root().alias("root"), nobody.alias("end"),
        F.lit(1).cast("long").alias("members"), "length",
    )
    root = sequences.sparkSession.range(1 if n else 0).select(
        _name_of_root().alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(low).cast("long").alias("conv_id"),
        F.lit(n).cast("long").alias("n_convs"),
    )
    nodes = [root]
    ends = [lengths.filter("length = 0").select(_name_of_root().alias("name"), "conv_id")]
    if depth:
        for level, blocks in reversed(list(enumerate(_blocks(sequences, depth)))):
            half = 1 << level
            cut = stage(_cut(open_, blocks, half), "cut")
            # A sequence without a named end is one conversation.
            over = (F.col("length") == F.col("above") + half) & F.col("end").isNull() & F.col("cut").isNotNull()
            ends.append(cut.filter(over).select(F.col("cut").alias("name"), "conv_id"))
            named, open_ = _halves(cut, half)
            nodes.append(named)
    # Sequences of one turn are left: each node's end once, under its parent.
    edges = open_.select(F.col("end").alias("name"), F.col("root").alias("parent"))
    found = nodes[0]
    for named in nodes[1:]:
        found = found.unionByName(named)
    zero = F.lit(0).cast("long").alias("kids")
    rows = found.withColumn("kids", zero).unionByName(edges.withColumn("kids", zero), allowMissingColumns=True)
    rows = rows.unionByName(edges.select(F.col("parent").alias("name"), F.lit(1).cast("long").alias("kids")), allowMissingColumns=True)
    met = rows.groupBy("name").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"),
        F.max("parent").alias("parent"), F.sum("kids").alias("n_children"),
    )
    last = sequences.select(F.col("conv_id").alias("_conv"), (F.col("place") + 1).alias("_depth"), "chars")
    met = met.join(last, (met.conv_id == F.col("_conv")) & (met.depth == F.col("_depth")), "left")
    met = stage(
        met.select(
            "name", "depth", "conv_id", "n_convs", "parent", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("saved_tokens"),
        ),
        "nodes",
    )
    totals = _grafted(met, depth).select("name", "parent", "depth", "n_leaves", "saved_tokens")
    top = totals.filter("depth = 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = top.filter(F.lit(bool(n))).select(
        _name_of_root().alias("name"), nobody.alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    every = ends[0]
    for more in ends[1:]:
        every = every.unionByName(more)
    few = met.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    parents = met.select(F.col("name").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    known = met.drop("n_leaves", "saved_tokens", "parent")
    result = known.join(small(totals.unionByName(whole).drop("depth")), "name")
    result = result.join(small(parents), F.col("parent") == F.col("_parent"), "left")
    result = result.join(small(_joined_ids(every)), "name", "left")
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(sequences, conversations): every conversation c with the first h turns of conversation c - c % group
    in place of its own first h, where h is the CRC-32 of its decimal id modulo ``most``."""
    own = stage(numbered(turns), "numbered")
    ids = turns.select(F.col("`conv_id`").cast("long").alias("conv_id")).filter("conv_id is not null").distinct()
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = ids.select("conv_id", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    # At most most - 1 turns of a base go to at most group conversations on either side of zero.
    heads = own.filter(F.col("place") < most - 1)
    bases = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("held"))
    lent = ids.join(bases, "base", "left").select(
        "conv_id", "taken", "base", F.least("taken", F.coalesce("held", F.lit(0))).alias("lent")
    )
    first = lent.join(heads.withColumnRenamed("conv_id", "from"), F.col("base") == F.col("from"))
    first = first.filter(F.col("place") < F.col("taken")).select("conv_id", "place", "symbol", "chars")
    rest = own.join(lent, "conv_id").filter(F.col("place") >= F.col("taken"))
    rest = rest.select("conv_id", (F.col("place") - F.col("taken") + F.col("lent")).alias("place"), "symbol", "chars")
    return first.unionByName(rest), ids.select("conv_id")
