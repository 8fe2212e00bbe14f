"""Words of a batch of texts as 64-bit hashes, and hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

K = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size words; of all words if there are fewer, none if there are none."""
    if len(words) < size:
        size = len(words)
    if not size:
        return words[:0]
    found = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        found = found * K + words[k : len(words) - size + 1 + k]
    return mixed(found)
