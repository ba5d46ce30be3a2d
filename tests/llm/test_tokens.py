"""Binary records and SentencePiece models."""

import gc
import os
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from newsburst.llm import packing, pieces, queries, records
from newsburst.llm.wordids import WordIds
from newsburst.llm.queries import model_file

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
TEXTS = [
    None, "", "Hello, world. It's   1 of 23!", " áb  x  we'll o'clock's '", "İstanbul ΑΣ ΟΔΟΣ. Σ̇", "x\x01y \x01 z",
    "a<|endoftext|>b", "ǨJ̌   q\x1cw \x85 3²٣", "don't. ,'s 'S 'LL", "😀 hi—there “q”", "≠ ≮ a.,., é. ., ,é. x.'s",
    "word " * 20_000, "y" * 5_000, "日本 語 \u00a0\u3000 z",
]


def test_records(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7 * i % 31, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "twin"), (5, "twin")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", start string")
    target = records.record_path(spark)
    records.write_records(docs, model_file("word_bpe_49k.json").decode(), 2, target)
    index = records.write_index(spark, target).collect()
    whole = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    expected, start = [], 0
    for d, t in order:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in index), key=lambda r: r[1])
    assert got == expected
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(target + "/part-*").collect()}
    for r in index:
        _, ids = records.parse(next(records.frames(files[r.file][r.offset : r.offset + r.length]))[2])
        assert len(ids) == r.n_tokens
    assert sorted(len(r.ids) for r in records.read_records(spark, target).collect()) == sorted(e[2] for e in expected)


def test_word_ids(monkeypatch):
    """Batches, with words kept from one to the next and forgotten, give the ids of whole texts."""
    coder = WordIds(model_file("word_bpe_49k.json").decode())
    odd = ["H̱ ẖ Å. á, word́. 3.", "ÀÉ. éÀ, ßẞ ĳ ǅ ﬁ. ſ", "3.14, e.g. x.y.z ... ,,, .", "a" * 5000 + ". " + "B" * 300, "_ _. --. 9.,"]
    texts = [t for t in TEXTS if "<|" not in (t or "")] + odd
    for kept in (1 << 20, 10):
        monkeypatch.setattr("newsburst.llm.wordids.KEPT_CHARS", kept)
        for batch in (texts, texts[::-1], TEXTS, [], [None]):
            offsets, ids = coder.encode(pa.array(batch, pa.string()))
            assert len(offsets) == len(batch) + 1
            for t, a, b in zip(batch, offsets, offsets[1:]):
                assert coder.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist()


def brute_pieces(tokens, most=4096):
    """(start, length) as the binary digits of the length give them."""
    start, found = 0, []
    while start < tokens:
        length = most
        while length > tokens - start:
            length //= 2
        found.append((start, length))
        start += length
    return found


def check_packing(docs, got, most):
    """All pieces of all rows, however often a document comes up, in sequences of one length a bucket."""
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for d, t in docs:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for a, n in brute_pieces(len(ids), most):
            expected.append((d, a, n, len(ids), zlib.crc32(ids[a : a + n].tobytes())))
    assert sorted(((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    by_number = sorted(got, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_number] == list(range(len(got)))
    assert [r.length for r in by_number] == sorted((r.length for r in got), reverse=True)


@pytest.mark.parametrize("most", [4096, 8, 1])
def test_packing(spark, most):
    rows = [(7 * i % 31, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "twin"), (5, "twin")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", length int, task string")
    path = packing.sequence_path(spark)
    packing.write_sequences(docs, model_file("word_bpe_49k.json").decode(), 2, path, most)
    got = packing.sequences(spark, path).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, got, most)


def test_packing_of_nothing(spark):
    path = packing.sequence_path(spark)
    model = model_file("word_bpe_49k.json").decode()
    packing.write_sequences(spark.createDataFrame([], DOCS), model, 2, path)
    assert packing.sequences(spark, path).count() == 0
    with pytest.raises(ValueError):
        packing.write_sequences(spark.createDataFrame([], DOCS), model, 2, path, 100)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_op13(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.callables()["op13_binary_packing"](spark, FOLDER).collect()
    check_packing(docs, got, 4096)
    assert all(r.offset == 0 for r in got)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_op6(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for d, t in docs:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.callables()["op6_binary_records"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected


def test_damage_is_found():
    good = records.frame(records.payload_of(3, b"\x01\x00", 2)) + b"\n"
    assert [p[0] for p in records.frames(good * 2)] == [0, len(good)]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(good[:-5]))


def test_no_records(spark):
    target = records.record_path(spark)
    records.write_records(spark.createDataFrame([], DOCS), model_file("word_bpe_49k.json").decode(), 2, target)
    assert records.write_index(spark, target).count() == 0


def test_pieces_equal_the_reference_library(spark):
    data = model_file("piece_bpe_32k.model")
    odd = [" ", "\n", " \n", "\n ", "a  b", "   x   y  ", " \n \n", "aaa aaaaaa ahahahaha", "<s> </s> <0x41>", "  " * 20 + "z"]
    rows = list(enumerate(TEXTS + odd + ["twin", "twin"]))
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", ids int")
    reference = SentencePieceProcessor(model_proto=data)
    for r in pieces.add_ids(docs, data).collect():
        text = rows[r.doc_id][1] or ""
        assert list(r.ids) == reference.encode(text) and r.n_tokens == len(r.ids)
        assert r.parity and r.round_trip
    assert pieces.add_ids(docs.limit(0), data).count() == 0


def test_a_marker_in_the_text_does_not_come_back(spark):
    r = pieces.add_ids(spark.createDataFrame([(1, "▁a")], DOCS), model_file("piece_bpe_32k.model")).first()
    assert r.parity and not r.round_trip


def test_whole_texts_where_chunks_are_not_safe():
    """The path for models that cannot be cut gives the same ids."""
    coder = pieces.PieceEncoder(model_file("piece_bpe_32k.model"))
    texts = [t.encode() for t in TEXTS if t is not None and len(t) < 1000]
    cut = coder.encode(texts)
    coder.model.trim_spaces = True
    whole = coder.encode(texts)
    assert all((a[0] == b[0]).all() and b[1] for a, b in zip(cut, whole))


def test_unigram_model():
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    def piece(text, score, kind=1):
        return part(1, part(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(kind))

    data = piece("<unk>", 0, 2) + piece("▁a", -1) + piece("b", -2) + piece("▁", -3) + piece("a", -3) + piece("ab", -2.5)
    data += part(2, b"\x18\x01") + part(3, b"\x18\x01\x20\x01")
    coder = pieces.PieceEncoder(data)
    assert coder.model.kind == pieces.UNIGRAM and not coder.model.cuttable
    for ids, parity in coder.encode([b"ab b", b"aab  ab", b"", b"  a "]):
        assert parity


def test_truncated_models_are_refused():
    with pytest.raises((ValueError, IndexError)):
        pieces.Model.parse(model_file("piece_bpe_32k.model")[:-3])


def test_word_ids_memory(monkeypatch):
    """Known words are no Python objects, and few texts at once are encoded one by one."""
    sent = []

    class Counting(WordIds):
        def whole(self, parts, tokenizer=None):
            real = tokenizer or self.tokenizer

            class Seen:
                @staticmethod
                def encode_batch_fast(texts, **options):
                    sent.append(len(texts))
                    return real.encode_batch_fast(texts, **options)

            return super().whole(parts, Seen)

    coder = Counting(model_file("word_bpe_49k.json").decode())
    text = pa.array([" ".join(f"a{i}" for i in range(60_000))])
    tracemalloc.start()
    try:
        offsets, ids = coder.encode(text)
        del offsets, ids
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 6e6
    finally:
        tracemalloc.stop()
    assert max(sent) <= 4_000
    assert coder.encode(text)[1].tolist() == coder.tokenizer.encode(text[0].as_py(), add_special_tokens=False).ids
