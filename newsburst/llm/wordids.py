"""Token ids of whole batches of texts, each distinct word encoded once.

For tokenizers whose pre-tokenizer drops white space, parts letters from digits and signs, and whose
tokens mark the end of a word: words then encode on their own, and words of letters alone can be
encoded many in one text and told apart by their last tokens. Everything per occurrence is done by
Arrow and NumPy on whole batches; Python meets a distinct word once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Characters of words kept from batch to batch; with their places and ids they take about five times as much memory.
KEPT_CHARS = 6 << 20
#: Texts joined for the tokenizer at once, and texts given to it one by one: an encoding takes far more memory than its ids.
JOINED = 20_000
SINGLE = 4_000
_PLAIN = "^[\x01-\x7fÀ-ÖØ-öø-ÿ]*$"
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_STOPPED = "^[\x01-\x7fÀ-ÖØ-öø-ÿ]*[0-9A-Za-zÀ-ÖØ-öø-ÿ][.,]+$"


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs that start and are as long as given, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class WordIds:
    """Ids of texts under a tokenizer given as JSON, without special tokens around them."""

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        suffix = json.loads(model)["model"].get("end_of_word_suffix")
        self.last = None
        if suffix:
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # The tokenizer lowers case itself: words that differ in case only are one.
        self.lowers = '"Lowercase"' in json.dumps(json.loads(model).get("normalizer"))
        self.lean = self._lean(json.loads(model)) if self.lowers else self.tokenizer
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special))
        self._forget()

    def _lean(self, parts: dict) -> Tokenizer:
        """The same model for lower-case letters between spaces: what else its pattern tells apart and its
        normalizer changes does not come up, so white space is all that is looked for."""
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or []
        pattern = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or r"[\p{L}]+" not in pattern:
            return self.tokenizer
        parts["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(parts | {"normalizer": None}))

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.chars = 0
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def whole(self, parts: list[str], tokenizer: Tokenizer | None = None) -> list[np.ndarray]:
        encode, found = (tokenizer or self.tokenizer).encode_batch_fast, []
        for at in range(0, len(parts), SINGLE):
            found += [np.array(e.ids, np.uint32) for e in encode(parts[at : at + SINGLE], add_special_tokens=False)]
        return found

    def _letters(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and their numbers, of words of letters, from joined texts cut behind the tokens that end a word."""
        found, sizes = [], []
        for at in range(0, len(words), JOINED):
            group = words[at : at + JOINED]
            ids = self.whole([" ".join(group)], self.lean)[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and len(ids) == ends[-1]:
                parts, length = [ids], np.diff(ends, prepend=0)
            else:
                parts = self.whole(group)
                length = np.array([len(p) for p in parts])
            found += parts
            sizes.append(length)
        return found, sizes

    def _learn(self, words: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Adds new words, and returns their places; ``letters`` tells those of letters alone."""
        joinable = letters if self.last is not None else np.zeros(len(words), bool)
        first, rest = np.flatnonzero(joinable), np.flatnonzero(~joinable)
        found, sizes = self._letters(words.take(pa.array(first)).to_pylist())
        others = self.whole(words.take(pa.array(rest)).to_pylist())
        lengths = np.concatenate([np.empty(0, np.int64), *sizes, [len(o) for o in others]]).astype(np.int64)
        order = np.concatenate([first, rest])
        place = np.empty(len(words), np.int64)
        place[order] = len(self.starts) + np.arange(len(words))
        self.known = pa.concat_arrays([self.known, words.take(pa.array(order))])
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.pool = np.concatenate([self.pool, *found, *others])
        self.chars += pc.sum(pc.utf8_length(words)).as_py() or 0
        return place

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The place in the pool of each distinct word."""
        words = words.cast(pa.large_string())
        found = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.chars > KEPT_CHARS:
                self._forget()
                new = np.arange(len(words))
            unknown = words.take(pa.array(new))
            letters = pc.match_substring_regex(unknown, _LETTERS).to_numpy(zero_copy_only=False)
            found[new] = self._learn(unknown, letters)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch: text i has ids[offsets[i] : offsets[i + 1]]; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.special and pc.any(pc.match_substring_regex(texts, self.special)).as_py():
            parts = self.whole(texts.to_pylist())
            return np.cumsum([0, *map(len, parts)]), np.concatenate([np.empty(0, np.uint32), *parts])
        split = pc.ascii_split_whitespace(texts)
        places = split.flatten().dictionary_encode()
        words = places.dictionary
        # Lower case first only where no character could combine with another.
        plain = pc.match_substring_regex(words, _PLAIN)
        words = pc.if_else(plain, pc.utf8_lower(words), words) if self.lowers else words
        # Stops behind a letter or digit are tokens of their own.
        stopped = pc.match_substring_regex(words, _STOPPED)
        bare = pc.if_else(stopped, pc.ascii_rtrim(words, characters=".,"), words)
        stops = pc.if_else(stopped, pc.extract_regex(words, "(?P<s>[.,]*)$").field(0), "")
        both = pa.concat_arrays([bare, stops]).dictionary_encode()
        slot = self._slots(both.dictionary)[both.indices.to_numpy()]
        slot = slot.reshape(2, -1)
        lengths = self.lengths[slot]
        # Ids of each distinct word of the batch, then of each occurrence.
        runs = ragged(self.starts[slot].T.ravel(), lengths.T.ravel())
        size = lengths.sum(axis=0)
        distinct = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), pa.array(self.pool[runs]))
        ids = distinct.take(places.indices).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[places.indices.to_numpy()])])
        return upto[split.offsets.to_numpy() - split.offsets[0].as_py()], ids


_kept: list[tuple[str, WordIds]] = []


def word_ids(model: str) -> WordIds:
    """One per Python worker, which keeps its words for all tasks that run there. A task has one thread: the
    tokenizer's own would each keep memory, and take CPU time in waiting for each other."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if not _kept or _kept[0][0] != model:
        _kept[:] = [(model, WordIds(model))]
    return _kept[0][1]
