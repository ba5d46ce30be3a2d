"""SentencePiece models run by the tokenizers library.

The model file, a protobuf message, is parsed here; from it a tokenizer is rebuilt: normaliser
(character map, extra white space, dummy prefix, space marker), a unigram model with its scores
or a BPE model whose merges follow from the scores, byte fallback, and user-defined pieces. The
``sentencepiece`` library serves only to verify parity.

Text is encoded in chunks that no piece can straddle: a chunk starts where a space follows a
non-space, or at a line feed. Spark parts the documents; a chunk's ids are kept per worker, and
every new chunk is also encoded by ``sentencepiece`` and decoded, so parity holds for all data,
not for a sample. Where the two differ, or decoding does not give the text back, the row says so.

Only models whose pieces keep the space marker in front, hold no line feed and normalise chunk by
chunk can be cut like this; for others whole texts are encoded.

Defined results: a null or empty text has no ids, parity and a round trip. Very long words are
encoded alone. Rows, repeated or not, are encoded one by one; an empty table gives none. Other columns
are ignored, or kept by ``add_ids``.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

from newsburst.llm.common import give_back, slices, texts
from newsburst.llm.wordcache import WordCache

SLICE_BYTES = 2 << 20
SPACE = "▁"

# Fixed values of the published message format: piece kinds, model kinds and field numbers.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def message(data: bytes):
    """(field number, value) of a protobuf message: int for varints, else bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"not a model file: wire type {kind}")
            size = varint()
        if at + size > len(data):
            raise ValueError("model file is cut off")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    character_map: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in message(data):
            if number == 1:
                piece = dict(message(value))
                score = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(message(value))
                model.kind = trainer.get(3, UNIGRAM)
                model.byte_fallback = bool(trainer.get(35, 0))
            elif number == 3:
                spec = dict(message(value))
                model.character_map = spec.get(2, b"")
                model.dummy_prefix = bool(spec.get(3, 1))
                model.trim_spaces = bool(spec.get(4, 1))
                model.escape_spaces = bool(spec.get(5, 1))
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return model

    @property
    def unknown(self) -> int | None:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)

    def core(self):
        """The library's model: unigram scores, or merges in the order of the merged pieces' scores."""
        if self.kind == UNIGRAM:
            return models.Unigram(
                [(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback
            )
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        usable = {p for p, _, kind in self.pieces if kind == NORMAL}
        merges = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
                merges += [(-score, ids[piece], cut) for cut in cuts if cut[0] in usable and cut[1] in usable]
        merges.sort(key=lambda m: m[:2])
        unknown = None if self.unknown is None else self.pieces[self.unknown][0]
        return models.BPE(
            ids, [m[2] for m in merges], unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback
        )

    def normalizer(self, prefix: bool):
        steps = []
        if self.character_map:
            steps.append(normalizers.Precompiled(self.character_map))
        if self.trim_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", SPACE))
        return normalizers.Sequence(steps)

    def tokenizer(self, prefix: bool | None = None) -> Tokenizer:
        """``prefix``: put a space in front, by default as the model says."""
        built = Tokenizer(self.core())
        built.normalizer = self.normalizer(self.dummy_prefix if prefix is None else prefix)
        built.add_tokens([AddedToken(p, normalized=True) for p, _, kind in self.pieces if kind == USER_DEFINED])
        return built

    @property
    def cuttable(self) -> bool:
        inner = any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        fits = self.dummy_prefix and self.escape_spaces and self.byte_fallback
        return fits and not (inner or self.character_map or self.trim_spaces)

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        decoded = []
        for piece, _, kind in self.pieces:
            if kind == BYTE:
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                decoded.append(b"")
            elif kind == UNKNOWN:
                decoded.append(b" \xe2\x81\x87 ")
            else:
                decoded.append(piece.replace(SPACE, " ").encode())
        return decoded


_BAD = b"\xff\xff\xff\xff"  # no id: put behind a chunk's ids where the libraries differ
_CHUNK = re.compile(rb"\n[^ \n]*| +[^ \n]*|[^ \n]+")


class PieceEncoder:
    """Encodes batches with the rebuilt tokenizer. ``verify``: compare with ``sentencepiece``."""

    def __init__(self, data: bytes, verify: bool = True, threads: int = 1):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.threads = threads
        self.model = Model.parse(data)
        self.plain = self.model.tokenizer(prefix=False)
        self.full = self.model.tokenizer()
        self.decoded = self.model.bytes_of()
        self.reference = None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self.reference = SentencePieceProcessor(model_proto=data)
            self.lone_space = self.reference.encode("\n")[:1]
        self.cache = WordCache(self._chunks)

    def _ids(self, tokenizer: Tokenizer, batch: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        as_text = [c.decode() for c in chunks]
        found = self._ids(self.plain, as_text)
        packed = [np.array(ids, "<i4").tobytes() for ids in found]
        if self.reference is None:
            return packed
        # The reference puts a space in front: a chunk's own first one, or one to take off again.
        given = [c[1:] if c.startswith(" ") else c for c in as_text]
        expected = self.reference.encode(given, num_threads=self.threads)
        result = []
        for text, ids, want, bits in zip(as_text, found, expected, packed):
            if text == " ":
                want = self.lone_space
            elif not text.startswith(" "):
                want = want[1:]
            result.append(bits if ids == want else bits + _BAD)
        return result

    def _cut(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        return _CHUNK.findall(b" " + text)

    def encode(self, batch: list[bytes]) -> list[tuple[np.ndarray, bool]]:
        """(ids, parity with the reference library) of each text."""
        if not self.model.cuttable:
            as_text = [t.decode() for t in batch]
            ids = self._ids(self.full, as_text)
            same = [True] * len(ids)
            if self.reference is not None:
                same = [a == b for a, b in zip(ids, self.reference.encode(as_text, num_threads=self.threads))]
            return [(np.array(i, np.int32), s) for i, s in zip(ids, same)]
        result = []
        for packed in self.cache.joined([self._cut(t) for t in batch]):
            ids = np.frombuffer(packed, "<i4")
            same = ids >= 0
            result.append((ids, True) if same.all() else (ids[same], False))
        return result

    def decode(self, ids: np.ndarray) -> bytes:
        joined = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return joined[1:] if self.model.dummy_prefix and joined.startswith(b" ") else joined


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(data: bytes, verify: bool, threads: int) -> PieceEncoder:
    """One per Python worker: its chunk cache serves all tasks that run there."""
    key = (zlib.crc32(data), len(data), verify, threads)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(data, verify, threads)
    return _encoders[key]


def add_ids(
    docs: DataFrame, data: bytes, verify: bool = True, threads: int | None = None, keep: tuple = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_tokens, ids, parity and round_trip of its text.

    ``data`` is the content of the model file; batches are encoded by as many threads as a task
    has cores (spark.task.cpus), or ``threads``.
    """
    threads = threads or int(docs.sparkSession.conf.get("spark.task.cpus", "1"))
    narrow = docs.select(*keep, docs["text"].alias("__text__"))
    schema = T.StructType(
        [
            *(docs.schema[c] for c in keep),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("parity", T.BooleanType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches):
        give_back()
        coder = encoder(data, verify, threads)
        for batch in slices(batches, "__text__", SLICE_BYTES):
            given = texts(batch.column("__text__"))
            coded = coder.encode(given)
            sizes = [len(i) for i, _ in coded]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = np.concatenate([i for i, _ in coded]) if coded else np.empty(0, np.int32)
            columns = [batch.column(c) for c in keep] + [
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                pa.array([same for _, same in coded], pa.bool_()),
                pa.array([coder.decode(i) == t for (i, _), t in zip(coded, given)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids", "parity", "round_trip"])

    return narrow.mapInArrow(run, schema)


def piece_counts(data: bytes) -> Counter:
    """Pieces by kind, to look at a model."""
    return Counter(kind for _, _, kind in Model.parse(data).pieces)
