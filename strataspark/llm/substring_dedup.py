"""Substring dedup by relative Lempel-Ziv parsing: words that a run of `window` words covers which also starts
anywhere else.

The pieces of a group of repeats.py are each other's reference blocks, and an index of their windows finds where a
factor may begin. A piece is parsed greedily: at a place whose window the index has in other blocks, the factor is as
long as the two blocks agree (a binary search over prefix hashes), the longest over all of them; a factor of `window`
words or more, whose words are compared byte by byte, is a duplicate span. Parsing goes on with the first window that crosses the factor's end, so that windows that no single
factor holds are checked at the boundary; a place without a match is a literal.

Words are found by hashes of 64 bits and compared by their bytes.

Defined cases: null texts have no words; texts shorter than the window lose nothing, copies or not; repeated rows are
copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from strataspark.llm import repeats
from strataspark.llm.suffix_dedup import common
from strataspark.llm.textops import prefix_hashes, range_hashes, scramble, words_of

WINDOW, GRAM = 35, 8


def _equal(pieces: repeats.Symbols, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words from x and from y on are the same, byte by byte."""
    bx, by = pieces.starts[x], pieces.starts[y]
    nx, ny = pieces.ends[x + length - 1] - bx, pieces.ends[y + length - 1] - by
    out = nx == ny
    at = np.flatnonzero(out)
    if not len(at):
        return out
    n = nx[at]
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    same = pieces.raw[np.repeat(bx[at], n) + step] == pieces.raw[np.repeat(by[at], n) + step]
    out[at] = np.logical_and.reduceat(same, first)
    return out


def match(pieces: repeats.Symbols, group: np.ndarray, p: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """The matcher of repeats.py by parsing. At each place the longest factor of all blocks of the group is taken."""
    prefix = prefix_hashes(pieces.values)
    begin, end = pieces.firsts[:-1], pieces.firsts[1:]
    slot = np.cumsum(many) - many
    member = np.repeat(np.arange(len(many)), many)
    start = begin[member] + np.arange(len(member)) - slot[member]
    w = range_hashes(prefix, start, start + window) ^ scramble(group[member].astype(np.uint64))
    index = np.argsort(w, kind="stable")
    w_sorted, member_sorted, start_sorted = w[index], member[index], start[index]
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    at = np.zeros(len(many), dtype=np.int64)
    live = np.flatnonzero(at < many)
    while len(live):
        here, mine = begin[live] + at[live], w[slot[live] + at[live]]
        k, last = np.searchsorted(w_sorted, mine), np.searchsorted(w_sorted, mine, side="right")
        held = np.zeros(len(live), dtype=np.int64)
        todo = np.arange(len(live))
        while len(todo := todo[k[todo] < last[todo]]):  # every block that has the window
            other = todo[member_sorted[k[todo]] != live[todo]]
            x, y = here[other], start_sorted[k[other]]
            length = common(prefix, x, y, np.minimum(end[live[other]] - x, end[member_sorted[k[other]]] - y))
            longer = np.flatnonzero(length - window + 1 > held[other])
            longer = longer[_equal(pieces, x[longer], y[longer], length[longer])]
            held[other[longer]] = length[longer] - window + 1
            k[todo] += 1
            todo = todo[held[todo] < many[live[todo]] - at[live[todo]]]  # no factor can be longer
        found = held > 0
        who = live[found]
        np.add.at(edge, slot[who] + at[who], 1)
        np.add.at(edge, slot[who] + np.minimum(at[who] + held[found], many[who]), -1)
        at[live] += np.maximum(held, 1)
        live = live[at[live] < many[live]]
    return np.cumsum(edge[:-1]) > 0


def _words(data: np.ndarray, bounds: np.ndarray) -> repeats.Symbols:
    """Words; the bytes are those of the words with one space behind each."""
    w = words_of(data, bounds)
    ends = np.cumsum(w.ends - w.starts + 1)
    begins = ends - (w.ends - w.starts + 1)
    raw = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    size = w.ends - w.starts
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    raw[np.repeat(begins, size) + step] = data[np.repeat(w.starts, size) + step]
    return repeats.Symbols(w.hashes, w.firsts, raw, begins, ends - 1)


def kept_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = repeats.GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, starts, ends: the removed runs of words of every document."""
    keyed = repeats.keyed_texts(docs)
    known = repeats.repeated(keyed, repeats.Kind(_words, window, min(gram, window)), match, group)

    def finish(text: bytes, starts: np.ndarray, ends: np.ndarray, copied: bool) -> tuple:
        words = text.split()  # bytes part at the same characters
        n = len(words)
        if copied and n >= window:
            starts, ends = np.array([0]), np.array([n])
        kept, at = [], 0
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            kept += words[at:a]
            at = b
        kept += words[at:]
        return n, int((ends - starts).sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), starts.tolist(), ends.tolist()

    names = ["n_words", "n_removed", "kept_sha256", "starts", "ends"]
    return repeats.apply(keyed, known, finish, "n_words long, n_removed long, kept_sha256 string, starts array<int>, ends array<int>", names)
