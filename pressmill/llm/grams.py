"""Hashed pieces of n consecutive characters, whole batches at a time."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def windows(c: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive codes (len(c) - n + 1 of them), by doubling."""
    if len(c) < n:
        return np.empty(0, np.uint64)
    h, size = c.astype(np.uint64) + np.uint64(1), 1
    bits = bin(n)[3:]
    base = h
    for bit in bits:
        h = h[:-size] * np.uint64(pow(_P, size, 1 << 64)) + h[size:]
        size *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(_P) + base[size:]
            size += 1
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))
