"""Token ids of words that tokenizers encode alike wherever they stand, kept per Python worker."""

from __future__ import annotations

import gc
from collections.abc import Callable
from itertools import chain

#: Longer words are not kept, so an entry's size is bounded.
KEY_BYTES = 64
#: Bytes kept per worker, and what an entry takes beside its word and ids.
KEPT_BYTES = 96 << 20
ENTRY_BYTES = 140


class WordCache:
    """Packed ids by word; when full it starts anew, so its memory is bounded."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], kept_bytes: int = KEPT_BYTES):
        self.encode = encode
        self.kept_bytes = kept_bytes
        self.held = 0
        self.known: dict[bytes, bytes] = {}

    def joined(self, split: list[list[bytes]]) -> list[bytes]:
        """The packed ids of each list of words, one after another."""
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects without cycles
        try:
            words = list(chain.from_iterable(split))
            packed = list(map(self.known.get, words))
            unknown = [i for i, p in enumerate(packed) if p is None]
            if unknown:
                new = list({words[i] for i in unknown})
                if self.held > self.kept_bytes:
                    self.known.clear()
                    self.held = 0
                found = dict(zip(new, self.encode(new), strict=True))
                for i in unknown:
                    packed[i] = found[words[i]]
                kept = {w: p for w, p in found.items() if len(w) <= KEY_BYTES}
                self.known.update(kept)
                self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
            result, at = [], 0
            for listed in split:
                result.append(b"".join(packed[at : at + len(listed)]))
                at += len(listed)
            return result
        finally:
            if collecting:
                gc.enable()
