"""Pivots of 64-bit fingerprints and the tables of distances to them."""

from __future__ import annotations

import functools

import numpy as np

PIVOTS = 16


@functools.cache
def pivots(n: int = PIVOTS, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, one row a fingerprint."""
    return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.uint8, copy=False)
