"""Random draws that depend on a row's key and the number of the draw only, so they are the same under every partitioning."""

from __future__ import annotations

import math

import numpy as np

#: Poisson(1) distribution function as bounds of 32-bit numbers; beyond twelve its probability is under one in 2**32.
_POISSON = np.array([min(2**32 - 1, round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) * 2**32)) for k in range(12)], dtype=np.uint32)


def mix(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """64-bit hashes (keys x numbers) of 64-bit key hashes and draw numbers, by the finalizer of splitmix64."""
    z = keys.astype(np.int64).view(np.uint64)[:, None] + (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def poisson(keys: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights (keys x draws) as bytes; each 64-bit hash gives two of them."""
    u = mix(keys, np.arange(1, (draws + 1) // 2 + 1)).view(np.uint32)[:, :draws]
    w = np.zeros(u.shape, dtype=np.uint8)
    for bound in _POISSON:
        w += u >= bound
    return w
