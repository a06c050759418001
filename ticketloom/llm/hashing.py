"""Hashes of words and of runs of words, for the operators that work on numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Words remembered by one worker.
REMEMBERED = 400_000
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word (bytes); computed once for each word met, within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


word_hashes = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of a splitting generator)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-th hash of each number."""
    return mix(x + np.uint64((n + 1) * int(_STEP) & (1 << 64) - 1))


def run_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """A hash for every run of ``words`` consecutive word hashes."""
    n = len(h) - words + 1
    if n <= 0:
        return h[:0]
    made = mix(h[:n])
    for k in range(1, words):
        made = mix(made + h[k:n + k] + _STEP)
    return made
