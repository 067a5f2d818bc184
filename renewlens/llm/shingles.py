"""Word shingles of a text as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Multipliers that tell the places of a shingle apart.
_WORD_MUL = np.random.default_rng(20240501).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text (A-Z lower-cased)."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    k = min(size, n)
    total = h[: n - k + 1] * _WORD_MUL[0]
    for j in range(1, k):
        total = total + h[j : n - k + 1 + j] * _WORD_MUL[j % 64]
    return np.unique(mix(total + _U(k)))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Number of common members of two sorted distinct arrays."""
    return int(np.intersect1d(x, y, assume_unique=True).size)


def node_of(shingles: np.ndarray) -> int | None:
    """A set's 64-bit digest as a long; none of an empty set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63 if len(shingles) else None
