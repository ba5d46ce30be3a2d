"""Repair of conversations with the fewest edits, by dynamic programming over sorted streams of turns.

A row's first fault counts: blank (no character other than white space), duplicate (role and text seen
earlier in the conversation), truncated (the last such character is no ``.``, ``!`` or ``?``). Edits: Keep a row
for nothing, Rerole it to user or assistant for 2, Delete it for 3, which blank rows and duplicates need,
Insert an empty turn of user or assistant for 2; a truncated row that is not deleted adds 1. Edits
of least cost whose initials give role initials ``(s?(ua)+)?`` are chosen, of equal ones the
least string of edits.

The first letters of the roles so far leave one of four states. What the rest of a conversation
costs from each, and the first edit then, hangs only on the same for the rows behind; so:

1. Narrow rows (no texts) meet by conversation, role and text digest, which finds duplicates.
2. They are dealt by conversation and sorted by turn, last first. A task streams through them in
   batches, carrying the costs of the four states, and writes the four edits of each row as one byte, in
   blocks of some thousand rows, and one row of counts per conversation.
3. Texts are dealt by conversation, sorted by turn, first first, each block in front of its rows. A task
   streams through both, follows the edits from the start and gives out the repaired rows.

A task holds a batch, a block and the state, whatever a conversation's length; only the audit of a
conversation, a letter for each row, grows with it. Blocks are a written table, no local file, so a
lost executor costs its tasks only.

Defined results: a null role or text is one space. Null turns come first; rows of one turn follow
by role and digest of the text. A null conv_id is a conversation. A role that is empty leaves the
state as it is. Equal rows of one turn follow each other, all but the first are duplicates.
No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsburst.session import stage

BLOCK_ROWS = 4096
SPACE = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 3
LETTERS = "KRDI"
#: The state behind a new turn, its role, and the state behind a kept row by its first letter.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Costs from each state at the end: a user's turn lacks one, a system's two.
END = (0, 4, 2, 0)


def after(state: int, letter: str) -> int | None:
    """The state behind a kept row, if it may be kept there."""
    return state if letter == "" else KEPT[state].get(letter)


def step(costs: tuple, letter: str, fault: int) -> tuple[tuple, int]:
    """Costs from each state before a row, given those behind it, and the four first edits as a byte."""
    extra = int(fault == TRUNCATED)
    best = []
    for state in range(4):
        options = [(3 + costs[state], "D")]
        if fault in (NONE, TRUNCATED):
            options.append((2 + extra + costs[NEXT[state]], "R"))
            kept = after(state, letter)
            if kept is not None:
                options.append((extra + costs[kept], "K"))
        best.append(min(options))
    # At most one turn is inserted before a row from user or assistant, two from the start.
    user = min(best[USER], (2 + best[ASSISTANT][0], "I"))
    assistant = min(best[ASSISTANT], (2 + best[USER][0], "I"))
    found = (min(best[START], (2 + user[0], "I")), min(best[SYSTEM], (2 + user[0], "I")), user, assistant)
    edits = sum(LETTERS.index(edit) << 2 * state for state, (_, edit) in enumerate(found))
    return tuple(cost for cost, _ in found), edits


class Costs:
    """The steps met so far, by differences of the costs: there are few."""

    def __init__(self):
        self.known: dict[tuple, tuple[tuple, int, int]] = {}

    def step(self, costs: tuple, letter: str, fault: int) -> tuple[tuple, int, int]:
        """(differences before the row, what the least has grown by, edits)."""
        key = (costs, letter if letter in "sua" else "?", fault)
        found = self.known.get(key)
        if found is None:
            raw, edits = step(costs, key[1], fault)
            least = min(raw)
            found = self.known[key] = (tuple(c - least for c in raw), least, edits)
        return found


def _rows(turns: DataFrame) -> DataFrame:
    known = turns.select(F.col("`conv_id`").cast("long"), F.col("`turn`").cast("long"), "`role`", "`text`")
    known = known.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    return known.withColumn("digest", F.md5("text"))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault) of all rows (conv_id, turn, role, text)."""
    spaces = F.lit(SPACE)
    last = F.right(F.rtrim("text", spaces), F.lit(1))
    rows = _rows(turns).select(
        "conv_id", "turn", "role", "digest",
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NONE).otherwise(TRUNCATED).alias("own"),
    )
    again = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    repeated = (F.row_number().over(again) > 1) & (F.col("own") != BLANK)
    return rows.withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("own"))).drop("own")


#: One row of counts per conversation (block null), and its blocks of edits, each with the turn, role and
#: digest of its first row; blocks count from the conversation's end.
_PLAN = (
    "conv_id long, block long, turn long, role string, digest string, edits binary, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long"
)
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


class _Conversation:
    """What is carried from row to row of a conversation, last row first."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.costs, self.cost = END, 0
        self.blocks, self.edits, self.first = 0, bytearray(), None
        self.faults = [0, 0, 0, 0]
        self.high = self.low = None
        self.turns = self.illegal = 0
        self.letter = None

    def block(self) -> tuple:
        row = (self.conv_id, self.blocks, *self.first, bytes(self.edits), *[None] * 6)
        self.blocks += 1
        self.edits = bytearray()
        return row

    def counts(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        total = self.cost + self.costs[START]
        return (self.conv_id, None, None, None, None, None, gaps, *self.faults[1:], self.illegal, total)


def _plan(block_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PLAN.split(", ")]
        steps, now = Costs(), None

        def frame(rows: list[tuple]) -> pd.DataFrame:
            columns = dict(zip(names, zip(*rows)))
            whole = {n: pd.array(c, "Int64") for n, c in columns.items() if n not in ("role", "digest", "edits")}
            return pd.DataFrame({n: whole.get(n, pd.Series(c, dtype=object)) for n, c in columns.items()}, columns=names)

        for batch in batches:
            out = []
            ids = [None if gone else i for i, gone in zip(batch.conv_id.tolist(), batch.no_id.tolist())]
            turns = [None if gone else t for t, gone in zip(batch.turn.tolist(), batch.no_turn.tolist())]
            for conv_id, turn, role, digest, fault in zip(
                ids, turns, batch.role.tolist(), batch.digest.tolist(), batch.fault.tolist()
            ):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out += [now.block(), now.counts()]
                    now = _Conversation(conv_id)
                elif len(now.edits) >= block_rows:
                    out.append(now.block())
                letter = role[:1]
                now.costs, grown, edits = steps.step(now.costs, letter, fault)
                now.cost += grown
                now.edits.append(edits)
                now.first = (turn, role, digest)
                now.faults[fault] += 1
                if turn is not None and turn != now.low:
                    now.turns += 1
                    now.low = turn
                    now.high = turn if now.high is None else now.high
                if now.letter is not None and letter + now.letter not in ("su", "ua", "au"):
                    now.illegal += 1
                now.letter = letter
            if out:
                yield frame(out)
        if now is not None:
            yield frame([now.block(), now.counts()])

    return run


def plan(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The least cost, the counts and the edits of every conversation, written."""
    turn = F.col("turn")
    sent = faults(turns).select(
        F.coalesce("conv_id", F.lit(0)).alias("conv_id"),
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(turn, F.lit(0)).alias("turn"),
        turn.isNull().alias("no_turn"),
        "role",
        "digest",
        "fault",
    )
    dealt = sent.repartition("conv_id", "no_id").sortWithinPartitions(
        "no_id", "conv_id", "no_turn", F.desc("turn"), F.desc("role"), F.desc("digest"), F.col("fault") != DUPLICATE
    )
    return stage(dealt.mapInPandas(_plan(block_rows), _PLAN), "repair_plan")


class Walk:
    """Follows a conversation's edits from its start; ``feed`` takes the blocks in order."""

    def __init__(self):
        self.state = START
        self.blocks: deque[bytes] = deque()
        self.place = 0

    def feed(self, edits: bytes) -> None:
        self.blocks.append(edits[::-1])

    def row(self, role: str) -> list[tuple[str, str | None]]:
        """Edits up to and at the next row, each with the role it leaves; None leaves the row's own."""
        edits = self.blocks[0][self.place]
        self.place += 1
        if self.place == len(self.blocks[0]):
            self.blocks.popleft()
            self.place = 0
        found = []
        while True:
            edit = edits >> 2 * self.state & 3
            if edit == DELETE:
                return [*found, ("D", None)]
            if edit == KEEP:
                self.state = after(self.state, role[:1])
                return [*found, ("K", None)]
            found.append((LETTERS[edit], ROLE[self.state]))
            self.state = NEXT[self.state]
            if edit == REROLE:
                return found

    def end(self) -> list[tuple[str, str]]:
        found = []
        while END[self.state]:
            found.append(("I", ROLE[self.state]))
            self.state = NEXT[self.state]
        return found


def _walked(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """Counts, blocks and rows of each conversation in the order in which they are needed."""
    rows = _rows(turns).withColumns({"rank": F.lit(2), "block": F.lit(None).cast("long")})
    rank = F.when(F.col("block").isNull(), 0).otherwise(1)
    both = rows.unionByName(planned.withColumn("rank", rank), allowMissingColumns=True)
    first = F.when(F.col("rank") == 0, 0).otherwise(1)
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("turn", *_COUNTS, "cost")]
    both = both.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("no_id"),
        first.alias("later"), F.col("turn").isNotNull().alias("has_turn"), "role", "digest", "rank",
        F.coalesce("block", F.lit(-1)).alias("block"), F.coalesce("text", F.lit("")).alias("text"), "edits", *numbers,
    )
    return both.repartition("conv_id", "no_id").sortWithinPartitions(
        "no_id", "conv_id", "later", "has_turn", "turn", "role", "digest", "rank", F.desc("block")
    )


def _follow(batches: Iterator[pd.DataFrame], begin, take, close):
    """Streams through conversations: ``begin(conv_id, counts)`` makes what collects one, ``take`` gets
    it and each edit with role, turn and text, ``close`` it at the end."""
    now = walk = held = None

    def end():
        for edit, role in walk.end():
            take(held, edit, role, None, "")
        close(held)

    for batch in batches:
        columns = ("conv_id", "no_id", "rank", "has_turn", "turn", "role", "text", "edits", *_COUNTS, "cost")
        for conv_id, no_id, rank, has_turn, turn, role, text, edits, *counts in zip(*(batch[c].tolist() for c in columns)):
            if rank == 0:
                if now is not None:
                    end()
                now, walk = (conv_id, no_id), Walk()
                held = begin(None if no_id else conv_id, counts)
            elif rank == 1:
                walk.feed(edits)
            else:
                for edit, left in walk.row(role):
                    mine = edit != "I"
                    take(held, edit, left or role, turn if mine and has_turn else None, text if mine else "")
        yield
    if now is not None:
        end()
    yield


_REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


class _Digest:
    """Audit and digest of a repaired conversation, which are fed row by row."""

    def __init__(self, conv_id, counts):
        self.head = (conv_id, *counts)
        self.audit = bytearray()
        self.sha = hashlib.sha256()
        self.begun = False

    def add(self, edit, role, turn, text) -> None:
        self.audit += edit.encode()
        if edit != "D":
            self.sha.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
            self.begun = True


def report(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """Per conversation of ``turns``: counts, least cost, the edits' initials in order (audit) and the
    digest of the repaired rows ``role:text``, joined by line feeds."""

    def run(batches):
        done: list[_Digest] = []
        names = [c.split()[0] for c in _REPORT.split(", ")]
        for _ in _follow(batches, _Digest, lambda held, *edit: held.add(*edit), done.append):
            rows = [(*d.head, d.audit.decode(), d.sha.hexdigest()) for d in done]
            done.clear()
            if rows:
                frame = pd.DataFrame(rows, columns=names)
                yield frame.assign(conv_id=pd.array([r[0] for r in rows], "Int64"))

    return _walked(turns, planned).mapInPandas(run, _REPORT)


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: place from 0, the edit that gave the row (K, R, I), its old
    turn, role and text."""

    def run(batches):
        out: list[tuple] = []
        names = [c.split()[0] for c in _REPAIRED.split(", ")]

        def take(held, edit, role, turn, text):
            if edit != "D":
                out.append((held[0], held[1], edit, turn, role, text))
                held[1] += 1

        for _ in _follow(batches, lambda conv_id, _: [conv_id, 0], take, lambda held: None):
            if out:
                frame = pd.DataFrame(out, columns=names)
                whole = {n: pd.array([r[names.index(n)] for r in out], "Int64") for n in ("conv_id", "turn")}
                out.clear()
                yield frame.assign(**whole)

    return _walked(turns, planned).mapInPandas(run, _REPAIRED)


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of ``turns`` (conv_id, turn, role, text)."""
    planned = plan(turns, block_rows)
    return report(turns, planned), repaired(turns, planned)


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with known faults, by the CRC-32 of ``conv_id:turn`` modulo 20: rows that are
    dropped (0), emptied (1), without ``.!?`` (2), repeated (3), of the role user (4). Nulls are one space."""

    def spaced(column) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    rows = turns.select(F.col("`conv_id`").cast("long"), F.col("`turn`").cast("long"), "`role`", "`text`")
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    left = rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies))
    return left.drop("col")
