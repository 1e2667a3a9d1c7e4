"""Hashed word features shared by the two text classifiers.

Features of a text are presence indicators in a table of 2**bits places: word
n-grams, skip-grams (pairs with one word between), and prefixes of words (in bytes), which
stand for the word in languages that inflect. Hashes are CRC-32 of UTF-8 and a
fixed mixing of word hashes, so drivers, executors and reruns agree.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np

_WORDS = re.compile(r"\w+").findall
_MIX_A, _MIX_B, _MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
CACHE_WORDS = 150_000


class WordHasher:
    """Text -> sorted distinct places. Keeps hashes of words met; emptied when full."""

    def __init__(self, bits: int = 20, prefixes: tuple[int, ...] = (4, 5, 6, 7, 8), pairs: bool = True, weights: np.ndarray | None = None):
        self.shift, self.prefixes, self.pairs = np.uint64(64 - bits), prefixes, pairs
        self.mask = (1 << bits) - 1
        self.known: dict[str, int] = {}
        self.single: dict[str, list[int]] = {}
        self.weights = weights  # with weights, only places that have one are kept by word

    def _of(self, words: list[str]) -> dict[str, None]:
        """The distinct words, all of them known afterwards."""
        distinct, known = dict.fromkeys(words), self.known
        if len(known) + len(distinct) > CACHE_WORDS:
            known.clear()
            self.single.clear()
        mask, weights = self.mask, self.weights
        for w in [w for w in distinct if w not in known]:
            raw = w.encode("utf-8", "surrogatepass")
            known[w] = h = crc32(raw)
            places = [h & mask, *[crc32(raw[:k], k) & mask for k in self.prefixes if len(raw) > k]]
            if weights is None or (places := [p for p in places if weights[p]]):
                self.single[w] = places
        return distinct

    def _pairs(self, words: list[str]) -> np.ndarray:
        h = np.frombuffer(array("Q", map(self.known.__getitem__, words)), np.uint64)
        two = ((h[:-1] * _MIX_A + h[1:]) * _MIX_B) >> self.shift
        skip = ((h[:-2] * _MIX_B + h[2:]) * _MIX_C) >> self.shift
        return np.concatenate([two, skip]).astype(np.int64)

    def places(self, text: str) -> np.ndarray:
        """All places of the text, sorted and distinct."""
        if not (words := _WORDS(text.lower())):
            return np.empty(0, np.int64)
        one = np.array([p for w in self._of(words) for p in self.single[w]], np.int64)
        return np.unique(np.concatenate([one, self._pairs(words)]) if self.pairs else one)

    def total(self, text: str) -> float:
        """Sum of ``weights`` over the text's places; only places with a weight are gathered."""
        if not (words := _WORDS(text.lower())):
            return 0.0
        distinct = self._of(words)
        found = {p for w in distinct if w in self.single for p in self.single[w]}
        if self.pairs:
            at = self._pairs(words)
            found.update(at[self.weights[at] != 0].tolist())
        return float(self.weights[sorted(found)].sum()) if found else 0.0
