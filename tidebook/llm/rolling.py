"""Hashes of any substrings of a buffer, from prefix sums: a polynomial modulo 2^64, mixed."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LEAST_TABLE = 3 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(31))
    h *= _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _powers(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class Roller:
    """Prefix sums of one buffer. The powers are kept for later buffers of the same process."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Roller.powers) < n:
            size = max(n, _LEAST_TABLE)
            Roller.powers, Roller.inverses = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * Roller.powers[: n - 1], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of every substring of this size."""
        return mixed((self.sums[size:] - self.sums[:-size]) * Roller.inverses[: len(self.sums) - size])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the substrings [start, stop), with their size."""
        return mixed((self.sums[stop] - self.sums[start]) * Roller.inverses[start] + (stop - start).astype(np.uint64))
