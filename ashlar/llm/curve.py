"""Hashed document vectors, their projection to few dimensions, and Hilbert keys, all on NumPy arrays."""

from __future__ import annotations

import math

import numpy as np

BUCKETS, DIMENSIONS, BITS, SEED = 256, 4, 10, 7


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), to hash token ids."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vectors(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit vector of signed hashed token counts, dampened by logarithm, for each list of ids."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    with np.errstate(over="ignore"):
        h = _mix(flat)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    cell = doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)
    x = np.bincount(cell, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    x = np.sign(x) * np.log1p(np.abs(x))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def keys(projected: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """The Hilbert key of each projected vector, after scaling by the corpus' mean and deviation."""
    z = (projected - mean) / np.where(deviation > 0, deviation, 1)
    share = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))
    return hilbert(np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position of integer cells (rows of coordinates below ``2**bits``) on the Hilbert curve.

    The published transposed form of the index: undo the rotations from the highest bit down, then Gray-encode, then
    interleave the bits of the coordinates.
    """
    x = [cells[:, i].copy() for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros(len(cells), np.int64)
    x = [c ^ flip for c in x]
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | ((c >> b) & 1)
    return out
