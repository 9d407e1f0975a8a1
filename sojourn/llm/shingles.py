"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from sojourn.llm import ragged

# What parts words.
WORD_GAPS = b" \t\n\x0b\x0c\r"
_GAP = np.zeros(256, bool)
_GAP[list(WORD_GAPS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
# Texts handled at a time.
SLICE_BYTES = 500_000


def words_of(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of every word; a word is a longest run without gaps, and only A-Z are lower-cased."""
    data = np.frombuffer(raw, np.uint8)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_GAP[data]
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return ragged.RangeHash(data)(starts, stops), starts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; fewer words are one shingle as a whole, none give none."""
    n = len(words)
    width = min(size, n)
    if n == 0:
        return words
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _FACTORS[0] + words[i : n - width + 1 + i] * _FACTORS[1 + i % 4]
        out ^= out >> np.uint64(29)
    return ragged.splitmix(out)


def text_slices(texts: list[str | None]):
    """Texts as bytes in slices of bounded size (one longer text is a slice of its own), joined by a gap."""
    raws, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.encode() if isinstance(text, str) else b""
        if raws and size + len(raw) > SLICE_BYTES:
            yield first, raws
            raws, size, first = [], 0, i
        raws.append(raw)
        size += len(raw) + 1
    if raws:
        yield first, raws


def shingle_sets(texts: list[str | None], size: int, lower: bool = True):
    """The sorted distinct shingle hashes of each text in turn."""
    for _, raws in text_slices(texts):
        words, starts = words_of(b" ".join(raws), lower)
        at = np.searchsorted(starts, ragged.ends(np.array([len(r) + 1 for r in raws])))
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], size))
