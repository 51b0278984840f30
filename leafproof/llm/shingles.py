"""64-bit hashes of word shingles, the same in every task."""

from __future__ import annotations

import re

import numpy as np

from .common import TO_LOWER, WORD, mix64

CACHE = 500_000


class Words(dict):
    """word -> a 64-bit hash, kept for one task; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return out


class Shingler:
    def __init__(self):
        self.known, self.find = Words(), re.compile(WORD).findall

    def words(self, text: str) -> list[str]:
        return self.find(text.translate(TO_LOWER))

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def windows(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """The hash of every k words in a row, in order; of all words if there are fewer; none without words."""
        n = len(hashes)
        k = min(k, n)
        if not k:
            return hashes
        out = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            out = mix64(out * np.uint64(3) + hashes[i : n - k + 1 + i])
        return out
