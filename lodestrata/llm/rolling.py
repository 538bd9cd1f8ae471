"""Polynomial hashes of slices of bytes, and sliding minima, as array operations."""

from __future__ import annotations

import functools

import numpy as np

#: Longest piece that is hashed at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to PIECE."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, b, np.uint64)])) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is quicker here than numpy's hash table."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


class SliceHash:
    """Hashes of any slices of one piece of at most PIECE uint64 or uint8 values."""

    def __init__(self, values: np.ndarray) -> None:
        self.up, self.down = _powers()
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Depends on a slice's values only; not spread yet."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def every(self, width: int) -> np.ndarray:
        """Spread hashes of all slices of the given width."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def long_slice(values: np.ndarray) -> np.uint64:
    """What SliceHash.raw gives for all of values, whatever their number."""
    total, factor = 0, 1
    step = pow(_BASE, PIECE, 1 << 64)
    for lo in range(0, len(values), PIECE):
        part = values[lo : lo + PIECE]
        total += int(SliceHash(part).raw(np.array([0]), np.array([len(part)]))[0]) * factor
        factor = factor * step % (1 << 64)
    return np.uint64(total % (1 << 64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each slice of the given width."""
    done = 1
    while done * 2 <= width:
        x, done = np.minimum(x[:-done], x[done:]), done * 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x
