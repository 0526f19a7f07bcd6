"""Hashes of many stretches at once, by array operations modulo 2**64."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(31))


class Powers:
    """The powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self._bases = [np.uint64(base), np.uint64(pow(base, -1, 1 << 64))]
        self._held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self._held[0]) < n:
            for k, base in enumerate(self._bases):
                steps = np.full(n + n // 4, base, np.uint64)
                steps[0] = 1
                self._held[k] = np.cumprod(steps, dtype=np.uint64)
        return [h[:n] for h in self._held]
