"""Suffix order of a bounded block of strings, and which positions have a long common prefix with another.

The Burrows-Wheeler transform gives the common-prefix lengths of neighbours in suffix order by increasing value: every interval of
suffixes with a common prefix is extended backwards by one character, which yields the boundaries whose length is one more.
Stopping at ``least`` leaves unset exactly the neighbours that share ``least`` characters or more.
"""

from __future__ import annotations

import numpy as np

from sojourn.llm import ragged


def suffix_order(x: np.ndarray, least: int) -> np.ndarray:
    """Cyclic suffixes of small whole numbers (below 512) in the order of their first characters, more than ``least`` of them, by
    doubling the compared length from 7. Intervals of shorter prefixes are the same whatever the order of equal ones."""
    n = len(x)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | np.roll(x, -i).astype(np.int64)
    order = np.argsort(key)
    length = 7
    while True:
        step = np.empty(n, np.int64)
        step[0] = 0
        sorted_key = key[order]
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or length > least:
            return order
        key = rank * n + np.roll(rank, -length)
        order = np.argsort(key)
        length *= 2


def boundaries(x: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the order (and one past it), whether it shares fewer than ``least`` characters with the one before."""
    n = len(x)
    last_column = x[order - 1].astype(np.uint16)
    by_character = np.argsort(last_column, kind="stable")
    back = np.empty(n, np.int64)
    back[by_character] = np.arange(n)
    # The next and the last place with the same character before it.
    after, ahead = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = last_column[by_character[1:]] == last_column[by_character[:-1]]
    after[by_character[:-1][same]] = by_character[1:][same]
    ahead[by_character[1:][same]] = by_character[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(least):
        # All places of the intervals, and of each character in an interval the first and the last place.
        size = right - left
        at = ragged.ends(size)
        inside = np.repeat(left - at[:-1], size) + np.arange(at[-1])
        first = inside[ahead[inside] < np.repeat(left, size)]
        last = inside[after[inside] >= np.repeat(right, size)]
        # The intervals of one more character do not overlap, so their ends pair up in order.
        left, right = np.sort(back[first]), np.sort(back[last]) + 1
        new = ~known[right]
        left, right = left[new], right[new]
        if not len(right):
            break
        known[right] = True
    return known


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, which of its positions start ``least`` bytes that also start elsewhere in these strings."""
    lengths = np.array([len(s) for s in strings], np.int64)
    x = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    at = ragged.ends(lengths + 1)
    x[at[1:] - 1] = 0
    order = suffix_order(x, least)
    known = boundaries(x, order, least)
    shares = np.empty(len(x), bool)
    shares[order] = ~known[:-1] | ~known[1:]
    return [shares[a : a + max(0, n - least + 1)] for a, n in zip(at[:-1].tolist(), lengths.tolist(), strict=True)]
