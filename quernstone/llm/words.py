"""Words of UTF-8 text, split at bytes 0x20 and 0x09 to 0x0D, and their hashes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
STIR, TURN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LETTER = np.random.default_rng(10).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * STIR
    x = (x ^ (x >> np.uint64(27))) * TURN
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64."""
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the byte that it starts at."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    step = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = step[::2], step[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    size = ends - starts
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    terms = _LETTER[data[inside[1:-1]]] * powers(int(size.max()))[at]
    return mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64)), starts
