"""Whole batches of texts as arrays: bytes, words and their hashes, without a loop over words.

A batch's texts are one buffer of UTF-8 bytes. A word's hash is polynomial: each byte stands for a fixed 64-bit
number, weighted by a power of an odd base; differences of prefix sums, divided by the power at the word's start, do
not depend on where the word stands. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 2**64))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_SYMBOL = scramble(np.arange(1, 257, dtype=np.uint64) * BASE)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(have: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        while len(have) < n:
            have = np.concatenate([have, have * (have[-1] * base)])
    return have


def powers(n: int) -> np.ndarray:
    global _powers
    _powers = _grown(_powers, BASE, n)
    return _powers


def inverses(n: int) -> np.ndarray:
    global _inverses
    _inverses = _grown(_inverses, _INVERSE, n)
    return _inverses


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * BASE^j before each place, one more than values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values))[: len(values)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for arrays of places; equal ranges of equal values have equal hashes."""
    with np.errstate(over="ignore"):
        return scramble((prefix[end] - prefix[start]) * inverses(len(prefix))[start] + (end - start).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))


#: Bytes that part words. Fixed values.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = _SPACE.copy()
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of several texts: hashes, first word of each text (one more than texts), byte places of the words."""

    hashes: np.ndarray
    firsts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(data: np.ndarray, bounds: np.ndarray, lower: bool = False, marks_part: bool = False) -> Words:
    """data: bytes of the texts, one after another; bounds: where each begins, one more than texts."""
    if lower:
        data = _LOWERED[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~(_MARKS if marks_part else _SPACE)[data]
    begin, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    # a text's end also ends its last word
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]]
    begin[cut] = True
    starts = np.flatnonzero(begin)
    ends_mask = end
    ends_mask[cut] = True
    ends = np.flatnonzero(ends_mask)
    hashes = range_hashes(prefix_hashes(_SYMBOL[data]), starts, ends)
    return Words(hashes, np.searchsorted(starts, bounds), starts, ends)


def slices(column: pa.Array, most_bytes: int = 1_000_000, most_rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, data, bounds) for runs of rows of a string column of about most_bytes and most_rows at most; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1)
        last = min(last, first + most_rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words within a text, and the text of each; a text with fewer words but one has
    its whole sequence as its only shingle."""
    counts = np.diff(firsts)
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(counts)), number)
    start = firsts[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
    return range_hashes(prefix_hashes(hashes), start, np.minimum(start + width, firsts[1:][text])), text
