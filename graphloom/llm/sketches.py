"""Shingle sets, MinHash samples, band keys and odd sketches of texts, computed for a chunk of texts at once."""

from __future__ import annotations

import numpy as np

from . import tokens as K
from .tokens import U64

SHINGLE, BANDS, ROWS, BITS = 5, 32, 5, 1024
_FACTORS = K.stream(SHINGLE, 2) | U64(1)
_ABSENT = K.stream(SHINGLE, 3)
_XORS, _MULTIPLIERS = K.stream(BANDS * ROWS, 4), K.stream(BANDS * ROWS, 5) | U64(1)
_BAND = K.stream(BANDS, 6)
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingle_sets(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 5-word shingles of each text, sorted within it, and how many each text has.

    A text of one to four words has one shingle, its whole sequence; a text without words has none.
    """
    n = w.per_doc
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    if not count.sum():
        return np.zeros(0, U64), count
    first_word, first = np.cumsum(n) - n, np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(first - first_word, count)
    left = np.repeat(n, count) - (at - np.repeat(first_word, count))
    value = np.zeros(len(at), U64)
    top = len(w.hash) - 1
    for j in range(SHINGLE):
        value += np.where(left > j, w.hash[np.minimum(at + j, top)], _ABSENT[j]) * _FACTORS[j]
    value = K.mixed(value)
    sets = [np.unique(value[a : a + k]) for a, k in zip(first.tolist(), count.tolist(), strict=True) if k]
    size = count.copy()
    size[count > 0] = [len(s) for s in sets]
    return np.concatenate(sets), size


def minhashes(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima for each set; all sets must have a member."""
    first = np.cumsum(size) - size
    out = np.empty((len(size), BANDS * ROWS), U64)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((values ^ _XORS[k]) * _MULTIPLIERS[k], first)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: equal where all the band's minima are equal."""
    rows = minima.reshape(len(minima), BANDS, ROWS)
    key = np.repeat(_BAND[None, :], len(minima), 0)
    for r in range(ROWS):
        key = K.mixed(key ^ rows[:, :, r]) + U64(r + 1)
    return key


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """A parity bitmap of BITS bits for each sample: each (place, minimum) flips one bit."""
    place = np.arange(minima.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15)
    bit = (K.mixed(minima + place) >> U64(54)).astype(np.int64) % BITS
    flat = (bit + np.arange(len(minima))[:, None] * BITS).ravel()
    parity = np.bincount(flat, minlength=len(minima) * BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(minima), BITS), axis=1)


def estimated(popcount: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that an XOR population count of two odd sketches speaks for."""
    share = np.minimum(2 * np.asarray(popcount, float) / BITS, 1 - 1e-9)
    return 1 + BITS * np.log1p(-share) / (4 * BANDS * ROWS)


def popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POPULATION[a ^ b].sum(axis=-1, dtype=np.int64)
