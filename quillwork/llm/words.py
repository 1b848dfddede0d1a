"""Words of a UTF-8 text and the windows of words that it repeats.

Words are runs of other bytes than the six ASCII white spaces, which is how Python splits bytes and what
``[^\\x20\\x09-\\x0D]+`` matches in characters.
"""

from __future__ import annotations

import numpy as np

MIX = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, good within one process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def repeating(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, whether another window of the array has the same hash. Equal windows always
    have; unequal ones may by chance."""
    n = len(h) - width + 1
    if n < 2:
        return np.zeros(max(n, 0), dtype=bool)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        key += h[k : k + n] * MIX[k % len(MIX)]
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    out = np.zeros(n, dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open maximal stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
