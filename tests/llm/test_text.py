"""Quality rules, decontamination, repeated passages and the n-gram join."""

import random
import tempfile
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsburst.llm import chunks, decontam, partenum, quality, repeats

from . import brute

DOCS = "doc_id long, text string"


def collect(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


def same(df, columns, expected):
    assert collect(df, *columns) == sorted(expected, key=repr)


@pytest.fixture(scope="module")
def crowd():
    """Near and exact copies, short, empty and null texts, one very long one."""
    rng = random.Random(7)
    bases = [[f"W{rng.randrange(30)}" for _ in range(n)] for n in (1, 2, 4, 20, 60, 150)]
    rows = []
    for d in range(120):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = f"w{rng.randrange(30)}"
        rows.append((d, " \n".join(text) if d % 17 else None))
    rows.append((120, ""))
    rows.append((121, " ".join(f"w{rng.randrange(40)}" for _ in range(30_000))))
    return rows


def test_quality_counts(spark):
    texts = [
        None, "", "  \n\t ", "a b c", "one two three four five six seven eight nine ten",
        "x y z u v " * 6, "line a\nline a\n\n \nline b\nline a", "# * $ % & | < > word " * 3,
        "é ß 日本 \x0b a\x0cb " * 4, "a b c d e " + "f " * 30_000,
    ]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1, "", None), (1, "", "xx")]
    judged, name = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = judged.select("doc_id", "text", f"{name}.*").collect()
    assert len(got) == len(rows)
    for r in got:
        expected = brute.quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected
        assert not (r.base_failed and r.kept)


def test_quality_divergence(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["the", "of", "and", "house", "river", "was"]) for _ in range(120)) for _ in range(30)]
    junk = ["### $$$ " + " ".join(f"{rng.randrange(10**6)}|{rng.randrange(10**6)}" for _ in range(120))]
    rows = [(i, t, "en", 1) for i, t in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(clean) if not brute.quality(t)[5]}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("split(" in line or "xxhash64(" in line for line in filters)
    judged, name = quality.judge(docs)
    assert name != "quality"
    far = judged.filter("doc_id = 30").select(f"{name}.class_distance").first()[0]
    p = np.zeros(len(quality.CLASSES))
    for r in docs.collect():
        p += classes(r.text)
    q = classes(rows[30][1])
    assert far == pytest.approx(distance(q / q.sum(), p / p.sum()), abs=1e-9)


def classes(text):
    def kind(c):
        if "a" <= c <= "z":
            return 0
        if c in " \t\n\x0b\x0c\r":
            return 1
        if "A" <= c <= "Z":
            return 2
        if "0" <= c <= "9":
            return 3
        if c in ".,;:!?'\"()-":
            return 4
        return 5 if c in "#*$%&|<>" else 6 if ord(c) < 128 else 7

    return np.bincount([kind(c) for c in text], minlength=8).astype(float)


def distance(p, q):
    m = (p + q) / 2

    def divergence(a):
        held = a > 0
        return float((a[held] * np.log2(a[held] / m[held])).sum())

    return ((divergence(p) + divergence(q)) / 2) ** 0.5


def test_quality_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.keep_good(docs).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    rng = random.Random(5)
    bank = [[f"b{rng.randrange(12)}" for _ in range(n)] for n in (1, 4, 9, 10, 11, 25, 40, 25)]
    items = [(i, ", ".join(w).upper()) for i, w in enumerate(bank)] + [(8, None), (9, "?!"), (5, " ".join(bank[5]))]
    rows = [(0, None), (1, ""), (2, "...")]
    for d in range(3, 60):
        text = [f"b{rng.randrange(14)}" if rng.random() < 0.7 else f"x{d}" for _ in range(rng.randrange(40))]
        if d % 3 == 0:
            text[5:5] = rng.choice(bank)
        if d % 5 == 0:
            text += rng.choice(bank) * 2
        rows.append((d, " ".join(text)))
    rows += [rows[6], (61, "filler é " * 20_000 + " ".join(bank[6]))]
    docs = spark.createDataFrame([(*r, d) for d, r in enumerate(rows)], "doc_id long, text string, _found int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(docs, bench, block_bytes=block_bytes)
    digest = found.select(
        "doc_id", "n_words", decontam.hit_words(F.col("matches")).alias("n_hit"),
        F.size(decontam.hit_items(F.col("matches"))).alias("n_items"),
        F.sha2(F.array_join(decontam.hit_items(F.col("matches")), ","), 256).alias("items"),
        (F.size("matches") > 0).alias("hit"),
    )
    expected = brute.decontaminated(rows, items)
    same(digest, digest.columns, expected)
    kept = decontam.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(e[0] for e in expected if not e[5])


def test_matches_are_longest_and_placed(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    text = "x y " + " ".join(f"w{i}" for i in range(4, 19)) + " z"
    r = decontam.contamination(spark.createDataFrame([(1, text)], DOCS), bench).first()
    assert [tuple(m) for m in r.matches] == [("1", 4, 2, 15)] and r.longest == 15


def test_decontamination_of_nothing(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, bench).count() == 0
    assert decontam.contamination(spark.createDataFrame([(1, "a b")], DOCS), bench).first().matches == []


@pytest.mark.parametrize("chunk_bytes,path_bytes", [(1 << 30, 1 << 30), (600, 1 << 30), (300, 100)])
def test_repeats(spark, chunk_bytes, path_bytes):
    rng = random.Random(1)
    base = [f"w{rng.randrange(9)}" for _ in range(300)]
    rows = []
    for d in range(60):
        a = rng.randrange(250)
        text = [w if rng.random() > 0.04 else "zz" for w in base[a : a + rng.randrange(60)]]
        rows.append((rng.randrange(50) if d % 7 else None, " \n".join(text) if d % 9 else None))
    rows += [(70, ""), (71, "w1 " * 5000), (72, "w1 " * 5000), rows[3]]
    found = repeats.remove_repeats(
        spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", chunk int"), 4, chunk_bytes, path_bytes
    )
    same(found, ["doc_id", "n_words", "n_removed", "kept"], brute.without_repeats(rows, 4))
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(brute.words(t))
    for r in found.collect():
        for s in r.spans:
            assert s.source_doc_id < r.doc_id
            # Several rows may share the id of the source.
            passages = [w[s.source_start : s.source_start + s.n_words] for w in by_id[s.source_doc_id]]
            passages = [p for p in passages if len(p) == s.n_words]
            assert any(w[s.start : s.start + s.n_words] in passages for w in by_id[r.doc_id])


def test_repeats_take_little_cpu():
    """A chunk's words are split, numbered and joined without a Python object for each."""
    rng = random.Random(2)
    text = " \n".join(f"w{rng.randrange(3000)}" for _ in range(400_000))
    table = pa.table({"chunk": pa.array([0, 0], pa.int32()), "doc_id": [1, 2], "text": [text, text]})
    tracemalloc.start()
    try:
        words = repeats.Chunk.of(table, 13).words
        assert len(words) == 800_000 and tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()
    spans = repeats._prove(13)(table, repeats._cut_paths(13, 1)(table, repeats.table_of([], repeats._REPEATED)))
    taken = repeats._take_out(13)(table, spans).to_pylist()
    assert [r["n_removed"] for r in taken] == [0, 400_000]
    assert [r["kept"] for r in taken] == [" ".join(text.split()), ""]


def test_words_are_those_of_bytes():
    rng = random.Random(3)
    listed = ["".join(rng.choice(" \t\n\x0b\f\r\x1c\x85ab \u3000é") for _ in range(rng.randrange(12))) for _ in range(500)]
    listed += [None, "", " "]
    words, sizes = repeats.split_words(pa.array(listed, pa.string()).slice(3))
    expected = [(t or "").encode().split() for t in listed[3:]]
    assert sizes.tolist() == [len(e) for e in expected]
    assert words.cast(pa.large_binary()).to_pylist() == [w for e in expected for w in e]


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_are_even(spark):
    """A few long documents, and a doc_id with a third of the rows, do not make a heavy chunk."""
    rng = random.Random(4)
    rows = [(d, " ".join(f"w{rng.randrange(999)}" for _ in range(200 if 400 <= d < 410 else 4))) for d in range(800)]
    rows += [(500, " ".join(f"v{rng.randrange(60)}" for _ in range(8))) for _ in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    dealt, ranges = chunks.dealt_by_chunk(docs, 3000)
    sizes = dealt.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("size"), F.countDistinct("doc_id").alias("ids"))
    sizes = {r.chunk: r for r in sizes.collect()}
    assert dealt.count() == len(rows) and max(sizes) < len(ranges)
    assert max(r.size for r in sizes.values()) < 3 * 3000
    assert all(sizes[i].ids == 1 for i in sizes if ranges.count(ranges[i]) > 1) and len(set(ranges)) < len(ranges)
    same(
        repeats.remove_repeats(docs, 2, 3000), ["doc_id", "n_words", "n_removed", "kept"], brute.without_repeats(rows, 2)
    )


def test_join_of_a_parted_doc_id(spark):
    """Different texts of one doc_id lie in several chunks and keep the links of all."""
    rng = random.Random(6)
    many = [" ".join(f"a{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60]))) for _ in range(40)]
    rows = [(50, t) for t in many] + [(100 + i, t + " z") for i, t in enumerate(many)] + [(300 + i, f"b{i} c") for i in range(20)]
    got = {r.doc_id: r.component_id for r in partenum.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 80, 1000).collect()}
    assert got == {d: 50 if d < 300 else d for d, _ in rows}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 60)])
@pytest.mark.parametrize("chunk_bytes", [1 << 30, 2000])
def test_join(spark, crowd, words, percent, chunk_bytes):
    docs = spark.createDataFrame([(*r, 0) for r in crowd], DOCS + ", root int")
    found = partenum.near_duplicates(docs, words, percent, chunk_bytes)
    same(found, ["doc_id", "n_shingles", "component_id"], brute.components(crowd, words, percent))


def test_join_edge_rows(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text), (9, "zz"), (None, None)], DOCS)
    found = partenum.near_duplicates(docs, chunk_bytes=10)
    same(
        found, ["doc_id", "n_shingles", "component_id"],
        [(None, 6, None), (5, 6, 3), (5, 6, 3), (3, 6, 3), (9, 1, 9), (None, 0, None)],
    )
    kept = partenum.keep_one(docs)
    same(kept, ["doc_id", "text"], [(None, text), (3, text), (9, "zz"), (None, None)])
    assert partenum.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("visit_bytes", [1 << 30, 500])
def test_join_of_parted_visitors(spark, crowd, visit_bytes):
    docs = spark.createDataFrame(crowd, DOCS)
    found = partenum.near_duplicates(docs, 3, 80, 1000, visit_bytes)
    same(found, ["doc_id", "n_shingles", "component_id"], brute.components(crowd, 3, 80))


def template_rows(n, filled):
    """Texts of 100 words on one template, so many of them words of their own."""
    rng = random.Random(9)
    return [(d, " ".join([f"t{i}" for i in range(100 - filled)] + [f"x{d}y{rng.random()}" for _ in range(filled)])) for d in range(n)]


def test_join_visits_below_the_threshold(spark, monkeypatch):
    """A template's documents that share signatures but are too far apart do not visit each other."""
    rows = template_rows(60, 25)
    met = []
    meet = partenum._meet
    monkeypatch.setattr(partenum, "_meet", lambda own, visits, *a: met.append(visits.count()) or meet(own, visits, *a))
    found = partenum.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 80, 3000)
    same(found, ["doc_id", "n_shingles", "component_id"], brute.components(rows, 1, 80))
    assert met[0] > 0 and met[1] == 0


def test_prefixes_meet():
    """Linked sets have a shingle of their prefixes in common, however shingles are ordered."""
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90):
        for size in (1, 2, 7, 40, 300):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = (100 - percent) * 2 * len(a) // (100 + percent) // 2
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
            assert partenum.similar(a, b, partenum.Similarity(3, percent))
            for some in (a[:0], a[::2], b):
                held = rng.integers(2, 9, len(some))
                assert np.intersect1d(*(partenum.prefix(x, some, held, percent) for x in (a, b))).size


def test_signatures_meet(spark):
    """Sets that are similar enough share a signature, at every size and both sides of bands."""
    rng = np.random.default_rng(zlib.crc32(b"sets"))
    for percent in (60, 80, 90):
        for size in (1, 2, 3, 5, 8, 13, 17, 18, 40, 41, 100, 300):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                drop = (100 - percent) * 2 * len(a) // (100 + percent) // 2
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
                rule = partenum.Similarity(3, percent)
                for c in (b, a[(100 - percent) * len(a) // 100 :]):
                    assert partenum.similar(a, c, rule)
                    found, owner = partenum.signatures([a, c], percent)
                    shared = np.intersect1d(found[owner == 0], found[owner == 1]).size
                    assert shared >= max(partenum.least_shared(len(x), percent) for x in (a, c))


def test_join_removes_tables_with_sets(spark, monkeypatch):
    """Chunks' sets, opened rows and prefixes are gone when the result is read; their disk is not held to the end."""
    rows = template_rows(60, 25)
    wide, stage = [], partenum.stage

    def staged(df, name):
        found = stage(df, name)
        if name in ("local", "opened", "prefixes", "meeting"):
            wide.append((name, [Path(f.removeprefix("file://")) for f in found.inputFiles()]))
            assert wide[-1][1][0].exists()
        return found

    monkeypatch.setattr(partenum, "stage", staged)
    found = partenum.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 80, 3000)
    assert [name for name, _ in wide] == ["local", "opened", "prefixes", "meeting"]
    assert not any(f.exists() for _, files in wide for f in files)
    same(found, ["doc_id", "n_shingles", "component_id"], brute.components(rows, 1, 80))


def shuffle_files():
    """Shuffle files of this session's folders."""
    return {f for d in Path(tempfile.gettempdir()).glob("blockmgr-*") for f in d.glob("*/shuffle_*.data")}


def test_join_removes_shuffles_at_once(spark, monkeypatch):
    """What a step of the join has shuffled is gone when the next one begins, whether or not garbage is collected."""
    monkeypatch.setattr(partenum, "free_shuffles", lambda spark: None)
    left, stage, before = {}, partenum.stage, shuffle_files()

    def staged(df, name):
        found = stage(df, name)
        left[name] = shuffle_files() - before
        return found

    monkeypatch.setattr(partenum, "stage", staged)
    rows = template_rows(60, 25)
    found = partenum.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 80, 3000)
    assert {"shared", "local", "meeting"} <= set(left) and not any(left.values())
    same(found, ["doc_id", "n_shingles", "component_id"], brute.components(rows, 1, 80))


def test_join_shuffles_few_sets(spark, monkeypatch):
    """A template's texts share signatures, but too few rare shingles: their sets are not shuffled again."""
    rows = template_rows(60, 25)
    near = [(100 + d, t + " more") for d, t in rows[:3]]
    counted, meet = [], partenum._meet
    monkeypatch.setattr(partenum, "_meet", lambda own, *a: counted.append(own.count()) or meet(own, *a))
    found = partenum.near_duplicates(spark.createDataFrame(rows + near, DOCS), 1, 80, 3000)
    same(found, ["doc_id", "n_shingles", "component_id"], brute.components(rows + near, 1, 80))
    assert counted[1] <= 6


def test_prefixes_meet_often():
    """Linked sets have as many shingles of their prefixes in common as the join asks for, at any size and order."""
    rng = np.random.default_rng(5)
    for percent in (1, 10, 60, 80, 90, 100):
        for size in (1, 2, 7, 19, 20, 40, 300, 1001):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = (100 - percent) * 2 * len(a) // (100 + percent) // 2
            swapped = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
            for b in (swapped, a[(100 - percent) * len(a) // 100 :]):
                if not len(b) or not partenum.similar(a, b, partenum.Similarity(3, percent)):
                    continue
                for some in (a[:0], a[::2], b):
                    held = rng.integers(2, 9, len(some))
                    common = np.intersect1d(*(partenum.prefix(x, some, held, percent) for x in (a, b))).size
                    for mine in (a, b):
                        assert common >= partenum.met_least(-(-percent * len(mine) // 100), percent)


def test_sets_are_made_by_slices(monkeypatch):
    """A chunk's words and elements are held in slices; the sets and signatures are those of the whole."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(20_000)]
    held = pa.table({"doc_id": list(range(3000)), "text": [" ".join(rng.choices(words, k=rng.randrange(500))) for _ in range(3000)]})
    found = []
    for limits in ((partenum.SLICE_BYTES, partenum.ELEMENTS), (1 << 40, 1 << 40)):
        monkeypatch.setattr(partenum, "SLICE_BYTES", limits[0])
        monkeypatch.setattr(partenum, "ELEMENTS", limits[1])
        tracemalloc.start()
        classes = partenum.Classes.of(held, partenum.Similarity(5, 80))
        found.append((tracemalloc.get_traced_memory()[1], classes.signature.tobytes(), classes.owner.tobytes(), classes.class_of))
        tracemalloc.stop()
    assert found[0][1:] == found[1][1:] and found[0][0] < 0.7 * found[1][0]
