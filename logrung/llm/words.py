"""Hashes of the words and shingles of whole texts, many texts at a time.

Words are runs of anything but ASCII space, tab, line feed, vertical tab,
form feed and carriage return. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.Generator(np.random.PCG64(7))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = 1 << 14
_POWER = np.cumprod(np.full(_PLACES, 0x9E3779B97F4A7C15, np.uint64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


@dataclass
class Words:
    """Words of a run of texts, in order."""

    hashes: np.ndarray
    #: Text i has the words ``bounds[i]`` to ``bounds[i + 1]``.
    bounds: np.ndarray
    #: Code points in words, by text.
    chars: np.ndarray


def text_slices(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes of text: (first, last + 1)."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield first, last
        first = last


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Hashes of all words; a null text has none. ``lower`` maps A-Z to a-z first."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    none = np.zeros(len(texts) + 1, np.int64)
    if end == begin:
        return Words(np.zeros(0, np.uint64), none, none[1:])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end]
    edges = offsets - begin
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = edges[:-1][edges[:-1] < len(data)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, edges)
    points = np.concatenate(([0], np.cumsum(word & ((data & 0xC0) != 0x80))))
    chars = np.diff(points[edges])
    if not len(starts):
        return Words(np.zeros(0, np.uint64), bounds, chars)
    letters = data[word]
    if lower:
        letters = _LOWER[letters]
    begins = np.flatnonzero(first[word])
    lengths = np.diff(np.concatenate((begins, [len(letters)])))
    place = np.arange(len(letters)) - np.repeat(begins, lengths)
    sums = np.add.reduceat(_BYTE[letters] * _POWER[place & (_PLACES - 1)], begins)
    return Words(mix64(sums + lengths.astype(np.uint64) * _STEP), bounds, chars)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words of one text, by its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _STEP + words[i : i + n]
        total ^= total >> np.uint64(29)
    return mix64(total)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; fewer words than ``size`` make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < size:
        # The length goes in, so that it can't equal a full shingle of another text.
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, size))
