"""Benchmark decontamination by SimHash of item-sized windows.

Windows of as many words as an item has are compared with the items: fingerprints of 64 bits are the signs of sums
over the window's shingles, each shingle adding +1 or -1 a bit, as often as it occurs. The items' fingerprints are
indexed by blocks of bits: of two fingerprints within `radius`, at least one of b blocks differs in at most
floor(radius / b) bits, so that probing every block with that radius finds all of them. What is found is verified by
the similarity of the weighted shingles (a shingle's weight is its number of occurrences): the sum of the lesser
over the sum of the greater weights must reach `similarity`.

For each length that an item has, all windows of that length are looked up among all items of the length. A window
that reaches the similarity has that share of its shingles from items: windows with fewer are not fingerprinted, which
loses nothing and costs one lookup a word. The radius of 18 of 64 bits is some three deviations above the mean distance
(10) of sets of similarity 0.8, and three and a half below that of unrelated ones (32); a test measures the recall.

Words are runs of characters that are neither space nor ASCII marks, A-Z lower-cased. Items with fewer words than a
shingle are one shingle of their own length, which every run of as many words of a text is compared with; items
without words match nothing. Of the windows of an item that verify, those are kept that overlap no better one (no
earlier one, if as good).

The items' shingles are sent to the executors in parts of at most `most_shingles`, each part a pass of its own, so
that no broadcast grows without bound.

Defined cases: null texts match nothing; null items match nothing; repeated items each count; repeated rows give
repeated rows; empty tables give clean documents or an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.base import bound_batches, carried, carry
from strataspark.llm.textops import shingles, slices, words_of

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 18, 8
BITS = 64


def _signs(h: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each hash."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def near(prints: np.ndarray, indexed: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS) -> np.ndarray:
    """Matrix: which of the indexed fingerprints are within radius of each. Blocks are bytes; a pair is looked at
    whole only where some block differs in at most radius // blocks bits."""
    a = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
    b = indexed.astype("<u8").view(np.uint8).reshape(-1, 8)
    probed = np.zeros((len(a), len(b)), dtype=bool)
    every = np.arange(256, dtype=np.uint8)
    for k in range(blocks):
        table = _ONES[every[:, None] ^ b[None, :, k]] <= radius // blocks  # the block's index: value -> items
        probed |= table[a[:, k]]
    x, y = np.nonzero(probed)
    out = np.zeros_like(probed)
    out[x, y] = _ONES[a[x] ^ b[y]].sum(axis=1, dtype=np.int64) <= radius
    return out


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


@dataclass
class Items:
    ids: list[int | None]
    words: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray
    vocabulary: np.ndarray
    of: list[np.ndarray]  # the items of each shingle of the vocabulary
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # the items of each number of words, and their fingerprints
    short: dict[int, tuple[np.ndarray, list[np.ndarray]]]  # by words, for items under a shingle: vocabulary and items


def index_items(ids: list, texts: list, width: int = SHINGLE) -> Items:
    column = pa.array(texts, pa.large_string())
    kept, words, sets = [], [], []
    for first, last, data, bounds in slices(column):
        w = words_of(data, bounds, lower=True, marks_part=True)
        h, text = shingles(w.hashes, w.firsts, width)
        at = np.searchsorted(text, np.arange(last - first + 1))
        for i in range(last - first):
            if w.firsts[i + 1] > w.firsts[i]:
                kept.append(ids[first + i])
                words.append(int(w.firsts[i + 1] - w.firsts[i]))
                sets.append(h[at[i] : at[i + 1]])
    if not sets:
        none = np.zeros(0, dtype=np.uint64)
        return Items([], np.zeros(0, dtype=np.int64), [], none, none, [], {}, {})
    prints = fingerprints(np.array([_signs(s).sum(axis=0) for s in sets]))
    n_words = np.array(words)

    def vocabulary(some: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The shingles of some items, and the items of each."""
        if not len(some):
            return np.zeros(0, dtype=np.uint64), []
        owner = np.repeat(some, [len(sets[i]) for i in some])
        known, inverse = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        return known, [np.unique(x) for x in np.split(owner[order], np.cumsum(np.bincount(inverse))[:-1])]

    short = {int(m): vocabulary(np.flatnonzero(n_words == m)) for m in np.unique(n_words[n_words < width])}
    by_length = {int(m): ((at := np.flatnonzero(n_words == m)), prints[at]) for m in np.unique(n_words[n_words >= width])}
    return Items(kept, n_words, sets, prints, *vocabulary(np.flatnonzero(n_words >= width)), by_length, short)


def apart(windows: list[tuple[float, int]], words: int) -> list[int]:
    """Starts of the windows (similarity, start) that overlap no better one that is kept, in order."""
    kept: list[int] = []
    for _, p in sorted(windows, key=lambda w: (-w[0], w[1])):
        at = bisect.bisect_left(kept, p)
        if (at == 0 or p - kept[at - 1] >= words) and (at == len(kept) or kept[at] - p >= words):
            kept.insert(at, p)
    return kept


def match_text(h: np.ndarray, items: Items, hits: np.ndarray, n_words: int, similarity: float, radius: int, width: int = SHINGLE) -> list[tuple[int, int, int]]:
    """(item, first word, words) of the windows of each item that a text contains. h: hashes of the runs of
    `width` words at each place; hits: places of h that some item has.

    For every length of an item, the windows of that length are fingerprinted and looked up in the index of all items of
    the length; what the index gives is verified. A window of similarity s has at least s times its shingles from
    items; windows with fewer are left out, which loses nothing."""
    held = np.zeros(len(h) + 1, dtype=np.int64)
    held[hits + 1] = 1
    held = np.cumsum(held)
    windows: dict[int, list[tuple[float, int]]] = {}
    for m, (mine, prints) in items.by_length.items():
        k = min(m, n_words) - width + 1  # shingles of a window; a shorter text is its only window
        k = len(h) if k < 1 or n_words < m else k
        start = np.flatnonzero(held[k:] - held[: len(held) - k] >= similarity * k - 1e-9)
        for at in range(0, len(start), 4096):
            some = start[at : at + 4096]
            low, high = int(some[0]), int(some[-1]) + k
            for a in range(low, high - k + 1, 8192):  # windows over consecutive places share prefix sums
                inside = some[np.searchsorted(some, a) : np.searchsorted(some, a + 8192)]
                if not len(inside):
                    continue
                sums = np.concatenate([np.zeros((1, BITS), dtype=np.int32), np.cumsum(_signs(h[a : min(a + 8192 + k, high)]), axis=0, dtype=np.int32)])
                found = near(fingerprints(sums[inside - a + k] - sums[inside - a]), prints, radius)
                for x, y in np.argwhere(found).tolist():
                    p, item = int(inside[x]), int(mine[y])
                    s = weighted_similarity(h[p : p + k], items.shingles[item])
                    if s >= similarity:
                        windows.setdefault(item, []).append((s, p))
    return [(item, p, min(int(items.words[item]), n_words)) for item in sorted(windows) for p in apart(windows[item], min(int(items.words[item]), n_words))]


def _places(vocabulary: np.ndarray, h: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, first and last of its hashes, places among them) for the texts with hashes of the vocabulary."""
    if not len(vocabulary):
        return
    hits = np.flatnonzero(vocabulary[np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)] == h)
    for i in np.unique(text[hits]).tolist():
        a, b = np.searchsorted(text, (i, i + 1)).tolist()
        yield i, a, b, hits[np.searchsorted(hits, a) : np.searchsorted(hits, b)] - a


def search(docs: DataFrame, ids: list, texts: list, keep: list[str], similarity: float = SIMILARITY, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """Kept columns of docs and _hits: array of struct(item_id, start, words, nth), nth counting the windows of one row of
    the benchmark from 0, of one part of the benchmark."""
    sent = docs.sparkSession.sparkContext.broadcast(index_items(ids, texts, width))
    columns = [*keep, *([] if "text" in keep else ["text"])]
    item = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("nth", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            out: list[list] = []
            for first, last, data, bounds in slices(batch.column("text")):
                found: list[list] = [[] for _ in range(last - first)]
                w = words_of(data, bounds, lower=True, marks_part=True) if items.ids else None

                def add(i: int, hits: list[tuple[int, int, int]], found: list[list] = found) -> None:
                    before: dict[int, int] = {}
                    for k, p, m in hits:
                        before[k] = before.get(k, -1) + 1
                        found[i].append({"item_id": items.ids[k], "start": p, "words": m, "nth": before[k]})

                if len(items.vocabulary):
                    h, text = shingles(w.hashes, w.firsts, width)
                    for i, a, b, mine in _places(items.vocabulary, h, text):
                        add(i, match_text(h[a:b], items, mine, int(w.firsts[i + 1] - w.firsts[i]), similarity, radius, width))
                for m, (known, of) in items.short.items():
                    h, text = shingles(w.hashes, w.firsts, m)
                    for i, a, _, mine in _places(known, h, text):
                        windows: dict[int, list[tuple[float, int]]] = {}
                        for p in mine.tolist():
                            for k in of[np.searchsorted(known, h[a + p])].tolist():
                                windows.setdefault(k, []).append((1.0, p))
                        add(i, [(k, p, m) for k, at in windows.items() for p in apart(at, m)])
                out += found
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.list_(item))], names=[*keep, "_hits"])

    kinds = dict(docs.dtypes)
    return docs.select(*columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", _hits array<struct<item_id:long,start:int,words:int,nth:int>>")


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], similarity: float = SIMILARITY, radius: int = RADIUS, most_words: int = 2_000_000) -> DataFrame:
    """Kept columns and _hits over the whole benchmark. The benchmark is read in parts of at most most_words words;
    from the second part on, each part's items are added to those found before, in the same row."""
    bound_batches(docs.sparkSession)
    text = [] if "text" in keep else ["text"]
    out = docs.withColumn("_hits", F.array().cast("array<struct<item_id:long,start:int,words:int,nth:int>>"))
    parts = _parts(benchmark, most_words)
    part = next(parts, None)
    while part is not None:
        following = next(parts, None)
        out = search(out.withColumnRenamed("_hits", "_before"), *part, [*keep, *([] if following is None else text), "_before"], similarity, radius)
        out = out.withColumn("_hits", F.concat("_before", "_hits")).drop("_before")
        part = following
    return out.select(*keep, F.array_sort("_hits").alias("_hits"))


def _parts(benchmark: DataFrame, most_words: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the items, some most_words words at a time; the driver holds two parts."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len((row.text or "").split())
        if held + n > most_words and ids:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += n
    if ids:
        yield ids, texts


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, spans (item:first word:words, comma-joined)."""
    found = find(docs, benchmark, ["doc_id"])
    ids = F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["item_id"])))
    spans = F.array_join(F.transform("_hits", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["words"].cast("string"))), ",")
    return found.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size(F.filter("_hits", lambda x: x["nth"] == 0)).cast("long").alias("n_items"), ids.alias("item_ids"), spans.alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns."""
    packed = carry(docs, "text")
    return carried(find(packed, benchmark, packed.columns).where(F.size("_hits") == 0), docs.columns, ("text",))
