"""64-bit hashes of words and of windows of words, for the operators that run numpy on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = 0x9E3779B97F4A7C13  # odd; _STEP - 1 is twice an odd number


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class WordHasher:
    """Hashes lists of words (bytes). The memo is emptied when it holds most words."""

    def __init__(self, most: int = 300_000):
        self._memo, self._most = _Memo(), most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._memo) > self._most:
            self._memo.clear()
        return np.fromiter(map(self._memo.__getitem__, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """A bijective mix, so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of width consecutive words; none where there are fewer words.

    Polynomials over the ring of 64-bit integers, put together from windows of powers of two.
    """
    if len(h) < width:
        return np.empty(0, np.uint64)
    done, out, part, size = 0, None, h, 1
    while True:
        if width & size:
            piece = part[done : done + len(h) - width + 1]
            out = piece if out is None else out * np.uint64(pow(_STEP, size, 1 << 64)) + piece
            done += size
        if done == width:
            return finish(out)
        part = part[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + part[size:]
        size *= 2
