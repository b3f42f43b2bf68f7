"""Hashes of stretches of bytes, computed for many stretches at once in numpy.

A prefix sum of (random number of the byte) * BASE**place, modulo 2**64, gives the hash of any stretch
by one difference and one product, whatever its length and place.

Such sums cancel for some long pairs of texts whatever base and numbers are (Thue-Morse sequences of 1,024
letters). Where any text may come, `Stretches.of_any` cuts stretches into blocks too short for that and adds
up mixed hashes of their blocks.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def byte_numbers(number: int) -> np.ndarray:
    """A random number for each byte; another table for each `number`."""
    return np.random.Generator(np.random.PCG64(1000 + number)).integers(0, 1 << 64, 256, np.uint64)


def powers(name: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base ("up") or of its inverse modulo 2**64 ("down")."""
    if len(_powers[name]) < n:
        step = int(BASE) if name == "up" else pow(int(BASE), -1, 1 << 64)
        factors = np.full(max(n, 2 * len(_powers[name])), step, np.uint64)
        factors[0] = 1
        _powers[name] = np.multiply.accumulate(factors)
    return _powers[name][:n]


class Stretches:
    """Hashes of stretches of some bytes, not mixed."""

    def __init__(self, raw: np.ndarray, table: int = 0) -> None:
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(byte_numbers(table)[raw] * powers("up", len(raw)), out=self._sums[1:])

    def all(self, width: int) -> np.ndarray:
        """Of every stretch of `width` bytes."""
        n = len(self._sums) - width
        return (self._sums[width:] - self._sums[:n]) * powers("down", n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * powers("down", len(self._sums))[starts]

    def of_any(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of stretches of at least one byte, by blocks of BLOCK bytes from their start."""
        blocks = -(-(ends - starts) // BLOCK)
        firsts = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(firsts, blocks)
        low = np.repeat(starts, blocks) + number * BLOCK
        high = np.minimum(low + BLOCK, np.repeat(ends, blocks))
        each = mix(mix(self.of(low, high)) + number.astype(np.uint64) * BASE)
        total = np.add.reduceat(each, firsts) if len(firsts) else np.zeros(0, np.uint64)
        return mix(total + (ends - starts).astype(np.uint64) * BASE)
