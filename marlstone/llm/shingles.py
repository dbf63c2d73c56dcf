"""Word shingles as 64-bit hashes, computed with whole-array operations."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        size = max(n, 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _power[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: runs without ASCII white space, A-Z in lower case."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not raw.size:
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not start.size:
        return np.empty(0, np.uint64)
    terms = _BYTE[_LOWER[raw]] * _powers(_BASE, raw.size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mix((total[end] - total[start]) * _powers(_INVERSE, raw.size)[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``k`` words.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = word_hashes(text)
    if not words.size:
        return words
    width = min(k, words.size)
    n = words.size - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h + words[i : i + n]) * np.uint64(_BASE)
    return np.unique(mix(h))
