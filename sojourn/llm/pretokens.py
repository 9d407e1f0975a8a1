"""Splits many texts into the pre-tokens of the public byte-level pattern at once.

The pattern has five kinds of match: seven English contractions, and an optional leading space with letters, numbers or
other signs, and runs of white space that leave their last character to what follows. Where a match starts depends
only on the classes of neighbouring characters, so starts of a whole block of texts come from a few array comparisons.
``tests/llm`` compares this with the pattern itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE, BREAK = 0, 1, 2, 3, 4
BREAK_CODE = 0x110000
# What may follow an apostrophe as a match of its own, in the pattern's order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point; surrogates cannot occur in a text."""
    out = np.full(BREAK_CODE + 1, OTHER, np.uint8)
    every = "".join(map(chr, range(BREAK_CODE)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[BREAK_CODE] = BREAK
    return out


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a break after each, and the place of each text's first."""
    parts, lengths = [], np.zeros(len(texts), np.int64)
    stop = np.array([BREAK_CODE], "<u4")
    for i, text in enumerate(texts):
        part = np.frombuffer(text.encode("utf-32-le"), "<u4")
        lengths[i] = len(part) + 1
        parts += (part, stop)
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), firsts


def token_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every pre-token, in order; none holds a break."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[codes]
    starts = np.ones(n, bool)
    before = kind[:-1]
    here = kind[1:]
    # A run of one class goes on; a plain space belongs to the run of signs after it.
    starts[1:] = before != here
    joined = (codes[:-1] == 32) & (here < SPACE)
    starts[1:][joined] = False
    # The last character of white space before something else is a match, or the head of one.
    starts[:-1] |= (before == SPACE) & (here < SPACE)
    # A contraction: an apostrophe that heads its run with no space before it.
    for i in np.flatnonzero(starts & (codes == 39)):
        ahead = "".join(map(chr, codes[i + 1 : i + 3][kind[i + 1 : i + 3] == LETTER])) if kind[i + 1] == LETTER else ""
        found = next((c for c in CONTRACTIONS if ahead.startswith(c)), None)
        if found:
            after = i + 1 + len(found)
            starts[i + 1] = False
            starts[after] |= kind[after] == LETTER
    where = np.flatnonzero(starts)
    stop = np.append(where[1:], n)
    real = kind[where] != BREAK
    return where[real], stop[real]
