"""Vectorised hashing of words and shingles in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd constant modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _STEP, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of non-blank bytes) of the texts in order, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_BLANK[raw]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, cuts), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    letters = raw[word]
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_BYTE[letters] * powers(int(sizes.max()))[place], first)), counts


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The distinct hashed ``width``-word shingles of each text, sorted; a text of fewer words has its whole sequence as one."""
    low = [(t or b"").lower() for t in texts]
    h, counts = word_hashes(low)
    ends = np.cumsum(counts)
    rolled = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            m = max(0, len(h) - k)  # all texts together may have fewer words than a shingle
            rolled[:m] = rolled[:m] * _STEP + h[k:]
        rolled = mix(rolled)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            with np.errstate(over="ignore"):
                whole = np.uint64(n)
                for x in h[end - n : end]:
                    whole = mix(np.array([whole * _STEP + x], np.uint64))[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
