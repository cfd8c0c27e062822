"""Hashes of substrings in numpy: sums of byte values times powers of one base, modulo 2 ** 64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 21)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """``h`` with all bits spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))
