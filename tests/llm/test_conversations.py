"""Repair of conversations and the prefix trie."""

import hashlib
import os
import random
import re
import zlib
from functools import cache

import pytest

from newsburst.llm import queries, repair, trie

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SOLID = re.compile("[^\x20\x09-\x0d]")
GOOD = re.compile("(s?(ua)+)?")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def judged(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, found = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        if not solid:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    return found


def cheapest(rows):
    """All edit strings are searched, with what is left to do known by row and role initials so far."""

    @cache
    def rest(i, state):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                return 0, "", ()
        else:
            role, text, fault = rows[i]
            short = int(fault == "truncated")
            cost, edits, kept = rest(i + 1, state)
            options.append((cost + 3, "D" + edits, kept))
            if fault not in ("blank", "duplicate"):
                for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    behind = follow(state, new[:1])
                    if behind is not None:
                        cost, edits, kept = rest(i + 1, behind)
                        options.append((cost + price + short, letter + edits, ((new, text), *kept)))
        if inserted.count((i, state)) < 1:
            inserted.append((i, state))
            for new in ("user", "assistant"):
                behind = follow(state, new[0])
                if behind is not None and (i, behind) not in inserted:
                    cost, edits, kept = rest.__wrapped__(i, behind)
                    options.append((cost + 2, "I" + edits, ((new, ""), *kept)))
            inserted.remove((i, state))
        return min(options) if options else (10**9, "", ())

    inserted = []
    return rest(0, "")


def follow(state, letter):
    if letter == "":
        return state
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))


def brute_report(rows):
    """The report of one conversation of (turn, role, text)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    marked = judged(order)
    turns = [r[0] for r in order if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    letters = [r[1][:1] for r in order]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    cost, audit, kept = cheapest(marked)
    counts = [sum(f == name for *_, f in marked) for name in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))), kept


def as_rows(found):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found
    }


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for _ in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "a", "USER"])
            text = rng.choice(["", " \n", None, "Yes.", "No", "Why? ", "Well", "é日.", "x" * rng.randrange(4) + "!\n"])
            rows.append((c if c % 9 else None, rng.choice([None, *range(7)]), role, text))
    return rows


def plain(rows):
    by_id = {}
    for c, turn, role, text in rows:
        by_id.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    return by_id


@pytest.mark.parametrize("block_rows", [4096, 1, 3])
def test_repair(spark, block_rows):
    rows = conversations(block_rows, 70, 9)
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", cost int, edits string")
    report, repaired = repair.repair(turns, block_rows)
    expected = {c: brute_report(r) for c, r in plain(rows).items()}
    assert as_rows(report.collect()) == {c: e[0] for c, e in expected.items()}
    found = {}
    for r in sorted(repaired.collect(), key=lambda r: r.place):
        assert r.place == len(found.setdefault(r.conv_id, []))
        found[r.conv_id].append((r.role, r.text))
    assert found == {c: list(e[1]) for c, e in expected.items() if e[1]}
    for kept in found.values():
        assert GOOD.fullmatch("".join(r[:1] for r, _ in kept))


def test_repair_of_a_giant_conversation(spark):
    """Many batches and blocks."""
    rows = [(5, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(30_001)] + [(5, 7, "user", "turn 7.")]
    report, repaired = repair.repair(spark.createDataFrame(rows, TURNS), 1000)
    r = report.first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (0, 0, 0, 0, 1)
    # The second row of turn 7 and the last user have no answer.
    assert r.cost == 4 and r.audit == "K" * 9 + "I" + "K" * 29_993 + "I"
    assert repaired.count() == 30_004


def test_repair_of_equal_rows_and_of_nothing(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi.")] * 9 + [(2, None, None, None)], TURNS)
    assert as_rows(repair.repair(turns, 2)[0].collect()) == {c: brute_report(r)[0] for c, r in plain(turns.collect()).items()}
    report, repaired = repair.repair(turns.limit(0))
    assert report.count() == repaired.count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_op12(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    damaged = {}
    for c, turn, role, text in rows:
        mine = damaged.setdefault(c, [])
        kind = zlib.crc32(f"{c}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = queries.callables()["op12_streamed_repair"](spark, FOLDER)
    assert as_rows(found.collect()) == {c: brute_report(r)[0] for c, r in damaged.items()}


def brute_trie(sequences):
    """All nodes of the trie of {conv_id: [(symbol, chars)]}, prefix by prefix."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(s for s, _ in turns[:d]), []).append(c)
    children = {}
    for name in members:
        if name:
            children.setdefault(name[:-1], []).append(name)

    def saved(name):
        return (len(members[name]) - 1) * sequences[members[name][0]][len(name) - 1][1] if name else 0

    rows = []
    for name, convs in members.items():
        below = [x for x in members if x[: len(name)] == name]
        ends = sorted(c for c in convs if len(sequences[c]) == len(name))
        parent = min(members[name[:-1]]) if name else None
        rows.append((
            min(convs), len(name), parent, len(convs), len(children.get(name, [])), sum(x not in children for x in below),
            sum(saved(x) for x in below), sha(",".join(map(str, ends))),
        ))
    return rows


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("longest", [1, 2, 4, 5, 8, 13])
def test_trie(spark, longest):
    rng = random.Random(longest)
    sequences = {c: [] for c in range(-3, 40)}
    for c in sequences:
        if c > 0 and rng.random() < 0.7:
            other = sequences[rng.randrange(c)]
            sequences[c] = other[: rng.randrange(len(other) + 1)]
        if rng.random() < 0.7:
            grown = [(x, len(x)) for x in rng.choices(["a", "bb", "ccc"], k=rng.randrange(longest + 1))]
            sequences[c] = (sequences[c] + grown)[:longest]
    sequences[0] = [("a", 1)] * longest
    rows = [(c, i, s.encode(), n) for c, turns in sequences.items() for i, (s, n) in enumerate(turns)]
    found = trie.prefix_trie(
        spark.createDataFrame(rows, "conv_id long, place long, symbol binary, chars long"),
        spark.createDataFrame([(c,) for c in [*sequences, None, 3]], "conv_id long"),
    )
    assert sorted(map(tuple, found.select(NODE).collect()), key=repr) == sorted(brute_trie(sequences), key=repr)


def test_trie_pieces_of_ids(spark, monkeypatch):
    """A node at which very many conversations end, joined from many pieces."""
    monkeypatch.setattr(trie, "PIECE_BYTES", 100)
    rows = spark.range(5000).selectExpr("id as conv_id", "0L as place", "cast('x' as binary) as symbol", "2L as chars")
    nodes = trie.prefix_trie(rows, rows.select("conv_id")).collect()
    ids = sha(",".join(map(str, range(5000))))
    assert sorted(map(tuple, nodes), key=repr) == [(0, 0, None, 5000, 1, 1, 9998, sha("")), (0, 1, 0, 5000, 0, 1, 9998, ids)]


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()))
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        found[c] = [((role, text), len(text)) for _, role, text in base[:h] + turns[h:]]
    return found


def test_rebuilt_conversations(spark):
    """Nulls, ties, repeated rows, absent bases, one long conversation, clashing columns."""
    rows = conversations(11, 30, 9) + [(c, t, "user", f"é{t % 3}") for c in (100, 101, 199, 230, -5) for t in (1, 2, 2, 9)]
    rows += [(250, i, "a", "x") for i in range(700)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS + ", place int, depth int")
    found = trie.prefix_trie(*trie.rebuilt(turns)).select(NODE).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_trie(brute_rebuilt(rows)), key=repr)
    assert trie.prefix_trie(*trie.rebuilt(turns.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_op11(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = queries.callables()["op11_boas_trie"](spark, FOLDER).select(NODE).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_trie(brute_rebuilt(rows)), key=repr)
