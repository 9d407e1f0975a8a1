"""Arrays of unequal length laid end to end, for numpy code inside tasks."""

from __future__ import annotations

import numpy as np


def ends(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0+l1, ... of pieces with these lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def take(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces ``index`` of ``flat`` end to end, and their offsets."""
    starts = offsets[index]
    lengths = offsets[index + 1] - starts
    at = ends(lengths)
    where = np.repeat(starts - at[:-1], lengths)
    where += np.arange(at[-1])
    return flat[where], at


def splitmix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept for the next call."""
    have = _POWERS.get(name)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        out = np.full(size, base & _MASK, np.uint64)
        out[0] = 1
        have = _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return have[: n + 1]


class RangeHash:
    """64-bit hashes of any ranges of one array of small whole numbers, in constant time each.

    The hash of a range is the polynomial of its values with an odd base modulo 2^64, taken from running sums: a sum
    from a range's start is brought to a common power by the inverse of the base, which exists because it is odd.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = self.sums[1:]
        terms[:] = values
        terms += np.uint64(0x51)
        terms *= _powers("up", _BASE, n)[:-1]
        np.cumsum(terms, out=terms)
        self.down = _powers("down", pow(_BASE, -1, 1 << 64), n)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.sums[stop] - self.sums[start]) * self.down[start]
        return splitmix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
