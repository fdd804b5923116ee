"""Polynomial hashes of ranges of a code array, all at once."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hash of any range [s, e) of ``codes``; equal texts have equal hashes wherever they stand."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        table = mix(np.arange(int(codes.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[codes] * powers(BASE, n)[:n], out=self.sums[1:], dtype=np.uint64)
        self.back = powers(INVERSE, n)

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.back[s])

    def windows(self, k: int) -> np.ndarray:
        """Hash of every window of ``k`` codes."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])
