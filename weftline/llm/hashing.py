"""Hashes of all windows of a sequence, by doubling: a few vector operations for each bit of the width."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of polynomial hashes spread, so that the least of them are no pattern of the text."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k items (uint64); none if there are fewer."""
    if len(items) < k:
        return np.zeros(0, np.uint64)
    power, size, block, out, done, left = _BASE, 1, items, None, 0, k
    while left:
        if left & 1:
            if out is None:
                out, done = block, size
            else:
                n = len(items) - (done + size) + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + block[done : done + n]
                done += size
        left >>= 1
        if left:
            n = len(block) - size
            block = block[:n] * np.uint64(power) + block[size : size + n]
            power = power * power & _MASK
            size *= 2
    return mixed(out[: len(items) - k + 1])


def sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """Least or greatest value (`pick`) in each window of w."""
    size, block = 1, values
    while size * 2 <= w:
        block = pick(block[:-size], block[size:])
        size *= 2
    rest = w - size
    return pick(block[: len(block) - rest], block[rest:]) if rest else block
