"""Hashes of any run of a sequence from one pass of prefix sums, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the base and its inverse modulo 2**64, as far as needed."""

    base = inverse = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.base) <= n:
            size = 1 << (n + 1).bit_length()
            for name, by in (("base", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, by, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.base, cls.inverse


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Runs:
    """Hashes of runs of a sequence of numbers, the same wherever a run stands."""

    def __init__(self, values: np.ndarray):
        base, self._inverse = Powers.upto(len(values))
        self._sums = np.empty(len(values) + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum(values * base[: len(values)], dtype=np.uint64, out=self._sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the items first..last (not included)."""
        return mixed((self._sums[last] - self._sums[first]) * self._inverse[first] + (last - first).astype(np.uint64))
