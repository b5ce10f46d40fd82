"""Suffix-array dedup: bytes that a string of `window` bytes covers which also starts anywhere else.

Suffixes are compared by hashes: prefix polynomial hashes and binary search give the longest common extension of two
suffixes in a logarithmic number of steps, and mergesort orders them. Each group of repeats.py orders the suffixes
at its anchors in this way; the order of the suffixes that start one byte earlier follows from it by a stable sort on
that byte, and so on through every start that the anchor marks. Equal windows are neighbours in such an order.
Neighbours of equal hashes are compared byte by byte, so that no collision removes anything.

Defined cases: a null text is an empty one; texts shorter than the window lose nothing, copies or not; repeated rows
are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from strataspark.llm import repeats
from strataspark.llm.textops import _SYMBOL, prefix_hashes, range_hashes

WINDOW, GRAM = 200, 32


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of suffixes at a and b, at most `most`."""
    low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64).copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = range_hashes(prefix, a, a + mid) == range_hashes(prefix, b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def order_suffixes(values: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Members in order of (group, suffix values[start:end]); group is sorted. Mergesort, all groups' runs at once:
    an element's place in the merged run is its own place plus its rank in the other run, found by binary search."""
    n = len(start)
    first = np.searchsorted(group, group)
    count = np.searchsorted(group, group, side="right") - first
    order = np.arange(n)
    local = np.arange(n) - first
    width, largest = 1, int(count.max(initial=0))
    while width < largest:
        run = local // width
        sibling = (run ^ 1) * width
        low = np.minimum(sibling, count)
        high = np.minimum(sibling + width, count)
        begin = low.copy()
        right = (run & 1).astype(bool)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) // 2
            x, y = order[todo], order[first[todo] + mid]
            most = np.minimum(end[x] - start[x], end[y] - start[y])
            lcp = common(prefix, start[x], start[y], most)
            inside = lcp < most
            at = np.minimum(lcp, np.maximum(most - 1, 0))
            cx, cy = values[start[x] + at], values[start[y] + at]
            lx, ly = end[x] - start[x], end[y] - start[y]
            before = np.where(inside, cy < cx, (ly < lx) | ((ly == lx) & right[todo]))  # the other one stands before
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        place = first + (run & ~1) * width + (local - run * width) + (low - begin)
        merged = np.empty(n, dtype=np.int64)
        merged[place] = order
        order = merged
        width *= 2
    return order


def match(pieces: repeats.Symbols, group: np.ndarray, p: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """The matcher of repeats.py by suffix order."""
    values, bounds = pieces.raw, pieces.firsts
    prefix = prefix_hashes(_SYMBOL[values])
    padded = np.concatenate([values, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(shape=(len(values) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    begin, end = bounds[:-1], bounds[1:]
    anchor = begin + p
    out = np.zeros(int(many.sum()), dtype=bool)
    slot = np.cumsum(many) - many
    order = order_suffixes(values, prefix, anchor, end, group)
    back = 0
    while len(order):
        live = order[p[order] - many[order] < back]  # those whose windows reach so far back
        if len(live) > 1:
            start = anchor[live] - back
            w = range_hashes(prefix, start, start + window)
            twin = np.flatnonzero((w[1:] == w[:-1]) & (group[live[1:]] == group[live[:-1]]))
            a, b = start[twin], start[twin + 1]
            same = np.ones(len(twin), dtype=bool)
            for k in [*range(0, window - 8, 8), window - 8] if window >= 8 else []:
                same &= eights[a + k] == eights[b + k]
            for k in range(window) if window < 8 else []:
                same &= values[a + k] == values[b + k]
            twin = twin[same]
            for m in (live[twin], live[twin + 1]):
                out[slot[m] + p[m] - back] = True
        back += 1
        order = order[p[order] >= back]
        if len(order):
            order = order[np.argsort(group[order] * 256 + values[anchor[order] - back], kind="stable")]
    return out


def _bytes(data: np.ndarray, bounds: np.ndarray) -> repeats.Symbols:
    at = np.arange(len(data) + 1)
    return repeats.Symbols(data.astype(np.uint64), bounds, data, at[:-1], at[1:])


def kept_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = repeats.GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends: the removed runs of every document."""
    keyed = repeats.keyed_texts(docs)
    known = repeats.repeated(keyed, repeats.Kind(_bytes, window, min(gram, window)), match, group)

    def finish(text: bytes, starts: np.ndarray, ends: np.ndarray, copied: bool) -> tuple:
        n = len(text)
        if copied and n >= window:
            starts, ends = np.array([0]), np.array([n])
        digest, at = hashlib.sha256(), 0
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        return n, int((ends - starts).sum()), len(starts), digest.hexdigest(), starts.tolist(), ends.tolist()

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
    return repeats.apply(keyed, known, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>", names)
