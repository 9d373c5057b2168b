"""Hilbert keys of integer points, and the hashed projections that the packing and neighbour operators lay along the curve."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """uint64 keys of points[n, k] (integers under 2**bits, k * bits <= 63) by the transposed Gray code walk."""
    x = points.astype(np.uint64).T.copy()
    k = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        p = q - one
        for i in range(k):
            hit = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ t)
        q >>= one
    for i in range(1, k):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[k - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(k):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def axes(size: int, dims: int, seed: int) -> np.ndarray:
    """``dims`` orthonormal directions in ``size`` dimensions, the same on every machine."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, dims)))
    return q


def quantise(values: np.ndarray, bits: int, shift: float = 0.0, reach: float = 1.0) -> np.ndarray:
    """Values of [-reach, reach], moved by ``shift`` of the grid's width, as integers under 2**bits."""
    at = ((values / reach + 1) / 2 + shift) / (1 + shift if shift else 1)
    return np.clip(np.round(at * ((1 << bits) - 1)), 0, (1 << bits) - 1).astype(np.uint64)
