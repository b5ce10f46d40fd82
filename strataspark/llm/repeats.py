"""Repeated windows of a corpus: which runs of `window` symbols of a text also start anywhere else.

Symbols are bytes (suffix-array dedup) or words (substring dedup). The work is cut by content:

1. Texts that are equal are one text; a text that occurs twice repeats every window of its own.
2. Anchors: of the hashes of all k-grams inside a window, the least marks the window's anchor, the last one in a tie.
   Equal windows have equal anchors at equal places. Anchors stand some window / 2 symbols apart, and the anchors whose
   k-gram occurs once need no more work.
3. A piece is an anchor with the stretch of text that its windows cover. Equal pieces are one, with a count; all windows
   of a piece that occurs twice are repeated. So a passage that many texts share is a few pieces, pre-aggregated.
4. Different pieces of one k-gram are a group. Its matcher (suffix sort or parsing) finds the windows that they share.
   A group of more than `group` pieces is split by content first: each piece becomes two, by how far its windows begin
   before the anchor, and the pieces of a half meet only where the symbols that all windows of the half have in common
   are equal. That goes on until no group is too large; a half of one window has only equal pieces, which are one. Every
   group, however hot its anchor is, goes through the same matcher.
5. What is found for a piece goes to its occurrences, and from there to the texts, by joins.

Texts and pieces are told apart by 128 bits of a cryptographic digest of their content; anchors go by 64-bit hashes,
where a collision makes a group larger and nothing else. Bitmaps, sized by a count and of 8 MB at most, keep rows that
need no join out of the shuffles; where they are full, the joins still drop them. Only texts with repeated windows that
are no copies are shuffled. Intermediate tables are written to the shared folder and removed in the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.base import Store, bitmap_of, bits_for, bound_batches, in_bitmap, materialize
from strataspark.llm.textops import U, inverses, prefix_hashes, scramble, slices

#: Different pieces up to which a group meets in one task.
GROUP = 400
#: Bytes of text that a task turns into arrays at once, and bytes of pieces that it looks at together, or one group.
BYTES, GROUP_BYTES = 250_000, 1_000_000


@dataclass
class Symbols:
    """The symbols of several texts: values (uint64), first symbol of each text (one more than texts), the texts' bytes
    and where each symbol begins and ends in them. Equal runs of symbols have equal bytes."""

    values: np.ndarray
    firsts: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


@dataclass(frozen=True)
class Kind:
    """What a text is made of: symbols(data, bounds) of a slice of texts; also of pieces, cut from Symbols.raw."""

    of: Callable[[np.ndarray, np.ndarray], Symbols]
    window: int
    gram: int


@dataclass
class Marks:
    """Anchors in order: k-gram hash, its place, first and last window that it marks (places of symbols, counted over
    all texts of the slice), text."""

    h: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    text: np.ndarray

    def only(self, keep: np.ndarray) -> Marks:
        return Marks(self.h[keep], self.at[keep], self.lo[keep], self.hi[keep], self.text[keep])


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of `gram` values."""
    prefix = prefix_hashes(values)
    n = len(values) - gram + 1
    with np.errstate(over="ignore"):
        x = (prefix[gram:] - prefix[:-gram]) * inverses(n)[:n]
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
    return x


def anchors(values: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> Marks:
    """The anchors of all texts of a slice."""
    none = np.zeros(0, dtype=np.int64)
    sizes = np.diff(firsts)
    if not (sizes >= window).any():
        return Marks(np.zeros(0, dtype=np.uint64), none, none, none, none)
    h = _gram_hashes(values, gram)
    span, many = window - gram + 1, len(values) - window + 1
    # least hash of every window: the lesser of a block's rest and the next block's beginning
    grid = np.full((-(-len(h) // span), span), np.iinfo(np.uint64).max, dtype=np.uint64)
    grid.ravel()[: len(h)] = h
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    rest = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(rest[:many], ahead[span - 1 : span - 1 + many])
    # the anchor changes where the least hash does, or where it enters once more
    enters = h[span - 1 : span - 1 + many] == low
    change = enters.copy()
    change[0] = True
    change[1:] |= low[1:] != low[:-1]
    mark = np.flatnonzero(change)
    at = mark + span - 1
    for k in range(0, len(late := np.flatnonzero(~enters[mark])), 2000):
        s = mark[late[k : k + 2000]]
        found = h[s[:, None] + np.arange(span - 1, -1, -1)] == low[s][:, None]
        at[late[k : k + 2000]] = s + span - 1 - found.argmax(axis=1)
    # cut at the texts
    cut = np.union1d(mark, firsts[:-1][sizes >= window])
    text = np.searchsorted(firsts, cut, side="right") - 1
    hi = np.minimum(np.concatenate([cut[1:], [many]]) - 1, firsts[np.minimum(text + 1, len(firsts) - 1)] - window)
    keep = (hi >= cut) & (text < len(sizes))
    cut, hi, text = cut[keep], hi[keep], text[keep]
    place = at[np.searchsorted(mark, cut, side="right") - 1]
    return Marks(h[place], place, cut, hi, text)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), t: 128 bits of the text's digest, at_t and at_r: hashes of t, and of t and the row."""
    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("t"))
    return keyed.select("doc_id", "text", "t", F.xxhash64("t").alias("at_t"), F.xxhash64("t", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("at_r"))


def _column(rows: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, 16 * len(rows) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array) -> np.ndarray:
    """The other way round, as two numbers a row."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view(np.int64).reshape(-1, 2)


def _cut(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """raw[begin[i]:end[i]] as a binary column."""
    size = end - begin
    bounds = np.concatenate([[0], np.cumsum(size)])
    cut = raw[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(cut.tobytes())])


def _digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Two numbers for each stretch of bytes, from a digest of the bytes and the number beside them."""
    held = memoryview(np.ascontiguousarray(raw))
    out = bytearray()
    for b, e, n in zip(begin.tolist(), end.tolist(), salt.tolist(), strict=True):
        out += blake2b(held[b:e], digest_size=16, salt=n.to_bytes(8, "little")).digest()
    return np.frombuffer(bytes(out), dtype=np.int64).reshape(-1, 2)


def _salt(level: int, p: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A piece is told by its level, its anchor's place and its number of windows, beside its bytes."""
    return level << 48 | p << 24 | many


def _scan(keyed: DataFrame, kind: Kind, schema: str, emit: Callable, *bitmaps: np.ndarray) -> DataFrame:
    """The rows that emit(symbols, marks, t of the slice's texts, further bitmaps) makes of the texts. Of equal texts
    mostly one is read: the first two bitmaps tell the texts that occur twice, and the rows that stand for them and for
    all other texts of their places."""
    sent = keyed.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, stands, *rest = sent.value
        for batch in batches:
            keep = np.flatnonzero(~in_bitmap(twice, batch.column("at_t").to_numpy()) | in_bitmap(stands, batch.column("at_r").to_numpy()))
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            t = _rows(batch.column("t"))
            for first, last, data, bounds in slices(batch.column("text"), BYTES):
                found = kind.of(data, bounds)
                marks = anchors(found.values, found.firsts, kind.window, kind.gram)
                if len(marks.h) and (out := emit(found, marks, t[first:last], *rest)) is not None:
                    yield out

    return keyed.select("t", "at_t", "at_r", "text").mapInArrow(run, schema)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return starts[np.concatenate([[0], cut])], ends[np.concatenate([cut - 1, [len(ends) - 1]])]


#: A matcher gets the pieces' symbols, one piece a text, and each piece's group (in order), its anchor's place and its
#: number of windows, and tells for every window (in order of pieces) if another piece of the group holds it.
Matcher = Callable[[Symbols, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]

_PIECE = "key long, x1 long, x2 long, a int, b int, p int, many int, raw binary"


def _number(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _symbols(table: pa.Table | pa.RecordBatch, kind: Kind) -> Symbols:
    """The symbols of a table's pieces."""
    raw = table.column("raw")
    raw = (pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return kind.of(np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


def _matched(pieces: DataFrame, kind: Kind, match: Matcher) -> DataFrame:
    """(x1, x2, near, far): windows of pieces that other pieces of their key have, as runs of distances between the
    window's beginning and the anchor. A task looks at whole groups of some GROUP_BYTES together, or at one."""

    def told(table: pa.Table) -> pa.RecordBatch | None:
        names = np.stack([_number(table, c) for c in ("key", "x1", "x2")])
        fresh = np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)])  # a piece that came twice
        group = np.cumsum(np.concatenate([[0], names[0, 1:] != names[0, :-1]]))[fresh]
        several = np.bincount(group, minlength=group[-1] + 1)[group] > 1
        table = table.filter(pa.array(fresh)).filter(pa.array(several))
        if not table.num_rows:
            return None
        p, many = _number(table, "p"), _number(table, "many")
        held = match(_symbols(table, kind), group[several], p, many, kind.window)
        member = np.repeat(np.arange(len(many)), many)
        far = p[member] - (np.arange(len(member)) - np.repeat(np.cumsum(many) - many, many))
        member, far = member[held], far[held]
        if not len(member):
            return None
        cut = np.flatnonzero((np.diff(far) != -1) | (np.diff(member) != 0))  # runs within a piece
        firsts, lasts = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(far) - 1]])
        rows = pa.array(member[firsts])
        x1, x2 = (table.column(c).combine_chunks().take(rows) for c in ("x1", "x2"))
        return pa.RecordBatch.from_arrays([x1, x2, pa.array(far[lasts].astype(np.int32)), pa.array(far[firsts].astype(np.int32))], names=["x1", "x2", "near", "far"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                held.append(batch.slice(k, 1000))
                size += held[-1].get_total_buffer_size() if batch.num_rows <= 1000 else held[-1].nbytes
                if size < GROUP_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                last = int(np.argmax(key == key[-1]))  # where the last group begins, which may go on
                if last:
                    if (found := told(table.slice(0, last))) is not None:
                        yield found
                    table = table.slice(last)
                    held, size = table.to_batches(), table.nbytes
        if held and (found := told(pa.Table.from_batches(held))) is not None:
            yield found

    asked = pieces.select("key", "x1", "x2", "p", "many", "raw")
    return asked.repartition("key").sortWithinPartitions("key", "x1", "x2").mapInArrow(groups, "x1 long, x2 long, near int, far int")


def _split(pieces: DataFrame, kind: Kind, level: int) -> DataFrame:
    """Two pieces of each, with windows that begin far from the anchor and near it, and the piece (u1, u2) that they are
    from. A half's key is a digest of the symbols that all windows of the half have."""
    window = kind.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                found = _symbols(batch, kind)
                a, b, p, many = (_number(batch, c) for c in ("a", "b", "p", "many"))
                mid = (a + b) // 2
                for low, high in ((a, mid), (mid, b)):
                    far, near = np.minimum(p, high - 1), np.maximum(p - many + 1, low)
                    rows = np.flatnonzero(far >= near)
                    if not len(rows):
                        continue
                    anchor = (found.firsts[:-1] + p)[rows]
                    low, high, far, near = low[rows], high[rows], far[rows], near[rows]
                    begin, end = found.starts[anchor - far], found.ends[anchor - near + window - 1]
                    x = _digests(found.raw, begin, end, _salt(level, far, far - near + 1))
                    key = _digests(found.raw, found.starts[anchor - low], found.ends[anchor - high + window], _salt(level, low, high))[:, 0]
                    at = pa.array(rows)
                    ints = [pa.array(v.astype(np.int32)) for v in (low, high, far, far - near + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x[:, 0]), pa.array(x[:, 1]), *ints, _cut(found.raw, begin, end), batch.column("x1").take(at), batch.column("x2").take(at)], names=["key", "x1", "x2", "a", "b", "p", "many", "raw", "u1", "u2"])

    return pieces.select(*[f.split()[0] for f in _PIECE.split(", ")]).mapInArrow(run, f"{_PIECE}, u1 long, u2 long")


def repeated(keyed: DataFrame, kind: Kind, match: Matcher, group: int = GROUP) -> DataFrame:
    """keyed_texts() -> (t, copied, spans): texts that occur twice, and texts with repeated windows, with the spans
    (array of struct(s, e)) that those cover. Spans of copied texts may be missing."""
    store = Store(keyed.sparkSession, "repeats")
    window, span = kind.window, kind.window - kind.gram + 1
    if window >= 1 << 16:
        raise ValueError("windows have fewer than 65536 symbols")
    sized = lambda df, number: bitmap_of(df, number, bits_for(df.count()))
    texts = store.put(keyed.groupBy("t").agg(F.count("*").alias("n"), F.min("at_r").alias("stands")))
    copies = texts.where("n > 1").select("t", "stands")
    # a text that occurs once may take the place of one that occurs twice in the first bitmap; its row stands for it
    bits = bits_for(copies.count())
    place = F.pmod(F.xxhash64("t"), F.lit(bits))
    stand = store.put(texts.select("stands", place.alias("place")).join(copies.select(place.alias("place")).distinct(), "place", "left_semi").select("stands"))
    once = bitmap_of(copies, F.xxhash64("t"), bits), sized(stand, F.col("stands"))

    def every(found: Symbols, m: Marks, t: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(m.h.view(np.int64))], names=["h"])

    often = store.put(_scan(keyed, kind, "h long", every, *once).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    shared = sized(often, F.col("h"))

    def stretch(found: Symbols, m: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return m.at - m.lo, m.hi - m.lo + 1, found.starts[m.lo], found.ends[m.hi + window - 1]

    def number(t: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Of an occurrence."""
        with np.errstate(over="ignore"):
            return scramble(t[:, 0].view(np.uint64) + lo.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)

    def occur(found: Symbols, m: Marks, t: np.ndarray, shared: np.ndarray) -> pa.RecordBatch | None:
        m = m.only(in_bitmap(shared, m.h))
        p, many, begin, end = stretch(found, m)
        x = _digests(found.raw, begin, end, _salt(0, p, many))
        lo = m.lo - found.firsts[m.text]
        columns = [m.h.view(np.int64), x[:, 0], x[:, 1], number(t[m.text], lo), lo.astype(np.int32), p.astype(np.int32), many.astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), _column(t[m.text])], names=["h", "x1", "x2", "o", "lo", "p", "many", "t"])

    occurrences = store.put(_scan(keyed, kind, "h long, x1 long, x2 long, o long, lo int, p int, many int, t binary", occur, *once, shared))
    pieces = store.put(occurrences.groupBy("x1", "x2").agg(F.min("h").alias("h"), F.count("*").alias("n"), F.min("o").alias("o")))
    several = store.put(pieces.groupBy("h").agg(F.count("*").alias("pieces")).where("pieces > 1"))
    wanted = sized(pieces.join(several, "h", "left_semi"), F.col("o"))

    def cut(found: Symbols, m: Marks, t: np.ndarray, wanted: np.ndarray, shared: np.ndarray) -> pa.RecordBatch | None:
        m = m.only(in_bitmap(shared, m.h))
        lo = m.lo - found.firsts[m.text]
        m = m.only(in_bitmap(wanted, number(t[m.text], lo)))
        p, many, begin, end = stretch(found, m)
        x = _digests(found.raw, begin, end, _salt(0, p, many))
        ints = [pa.array(v.astype(np.int32)) for v in (np.zeros(len(p)), np.full(len(p), span), p, many)]
        return pa.RecordBatch.from_arrays([pa.array(m.h.view(np.int64)), pa.array(x[:, 0]), pa.array(x[:, 1]), *ints, _cut(found.raw, begin, end)], names=["key", "x1", "x2", "a", "b", "p", "many", "raw"])

    content = store.put(_scan(keyed, kind, _PIECE, cut, *once, wanted, shared))
    many = several.select(F.col("h").alias("key"), "pieces")
    full = lambda df: df.select("x1", "x2", F.lit(0).alias("near"), F.lit(span).alias("far"))
    settled, whole, parents = None, None, []
    while True:
        of_size = lambda large, content=content, many=many: content.join(many.where((F.col("pieces") > group) == F.lit(large)).select("key"), "key", "left_semi")
        settled = of_size(False) if settled is None else settled.unionByName(of_size(False))
        if many.where(F.col("pieces") > group).limit(1).count() == 0:
            break
        halves = store.put(_split(of_size(True), kind, len(parents) + 1))
        parents.append(halves.select("x1", "x2", "u1", "u2").distinct())
        same = halves.groupBy("x1", "x2").agg(F.min(F.struct("u1", "u2")).alias("u"), F.max(F.struct("u1", "u2")).alias("v"), F.min("key").alias("key"), *[F.min(c).alias(c) for c in ("a", "b", "p", "many")], F.min("raw").alias("raw"))
        held = store.put(same.withColumn("twice", F.col("u") != F.col("v")).drop("u", "v"))
        every_window = held.where("twice").select("x1", "x2", (F.col("p") - F.col("many") + 1).alias("near"), F.col("p").alias("far"))
        whole = every_window if whole is None else whole.unionByName(every_window)
        many = store.put(held.groupBy("key").agg(F.count("*").alias("pieces")).where("pieces > 1"))
        content = held.drop("twice")
    found = _matched(settled, kind, match)
    found = store.put(found if whole is None else found.unionByName(whole))
    told = found
    for above in reversed(parents):  # what holds for a half holds for the pieces that it is from
        up = told.join(above, ["x1", "x2"]).select(F.col("u1").alias("x1"), F.col("u2").alias("x2"), "near", "far").distinct()
        told = found.unionByName(store.put(up))
    told = told.unionByName(full(pieces.where("n > 1"))).distinct()
    near, far = F.greatest("near", F.col("p") - F.col("many") + 1), F.least("far", "p")
    covered = occurrences.select("x1", "x2", "t", "lo", "p", "many").join(told, ["x1", "x2"]).where(far >= near).select("t", (F.col("lo") + F.col("p") - far).alias("s"), (F.col("lo") + F.col("p") - near + window).alias("e"))
    spans = covered.groupBy("t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # bounded by the text
    known = materialize(copies.select("t", F.lit(True).alias("copied")).join(spans, "t", "full").select("t", F.coalesce("copied", F.lit(False)).alias("copied"), "spans"))
    store.clear()
    return known


def apply(keyed: DataFrame, known: DataFrame, finish: Callable, schema: str, names: list[str]) -> DataFrame:
    """doc_id and what finish(text's bytes, starts, ends, copied) makes of each text: a tuple of schema's fields, named
    names. known: the result of repeated(). Texts are shuffled only where they have spans and are no copies; copies
    get what finish makes of them as copies, by their keys."""
    spark = keyed.sparkSession
    bits = lambda df: bitmap_of(df, F.xxhash64("t"), bits_for(df.count()))
    sent = spark.sparkContext.broadcast((bits(known.where("copied")), bits(known.where("NOT copied"))))
    kind = dict(keyed.dtypes)["doc_id"]

    def made(texts, starts, ends, copied) -> list[pa.Array]:
        rows = [finish(x.as_py().encode(), s, e, c) for x, s, e, c in zip(texts, starts, ends, copied, strict=True)]
        return [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _types(schema), strict=True)] if rows else [pa.array([], t) for t in _types(schema)]

    def chosen(batches: Iterator[pa.RecordBatch], copied: bool, spanned: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at_t").to_numpy()
            c, s = in_bitmap(sent.value[0], at), in_bitmap(sent.value[1], at)
            batch = batch.filter(pa.array(s if spanned else ~s & (c == copied)))
            for k in range(0, batch.num_rows, 500):
                yield batch.slice(k, 500)

    none = np.zeros(0, dtype=np.int64)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chosen(batches, False, False):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made(batch.column("text"), [none] * n, [none] * n, [False] * n)], names=["doc_id", *names])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chosen(batches, True, False):
            n = batch.num_rows
            one, other = (made(batch.column("text"), [none] * n, [none] * n, [c] * n) for c in (False, True))
            pack = lambda v: pa.StructArray.from_arrays(v, names=names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pack(one), pack(other)], names=["doc_id", "t", "one", "other"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chosen(batches, False, True):
            yield batch.select(["doc_id", "t", "text"])

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                runs = [merged(np.asarray(s.values, dtype=np.int64), np.asarray(e.values, dtype=np.int64)) if s.is_valid else (none, none) for s, e in zip(batch.column("s"), batch.column("e"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made(batch.column("text"), [s for s, _ in runs], [e for _, e in runs], batch.column("copied").to_pylist())], names=["doc_id", *names])

    rows, out = keyed.select("doc_id", "text", "t", "at_t"), f"doc_id {kind}, {schema}"
    copied = known.where("copied").select(F.col("t").alias("c_t"))
    fields = schema.replace(", ", ",").replace(" ", ":")
    by_key = rows.mapInArrow(either, f"doc_id {kind}, t binary, one struct<{fields}>, other struct<{fields}>")
    by_key = by_key.join(copied, F.col("t") == F.col("c_t"), "left").select("doc_id", F.when(F.col("c_t").isNull(), F.col("one")).otherwise(F.col("other")).alias("v")).select("doc_id", "v.*")
    spans = known.select(F.col("t").alias("k_t"), "copied", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))
    joined = rows.mapInArrow(asked, f"doc_id {kind}, t binary, text string").join(spans, F.col("t") == F.col("k_t"), "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "s", "e")
    return rows.mapInArrow(plain, out).unionByName(by_key).unionByName(joined.mapInArrow(spanned, out))


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return [kinds[field.split(" ")[1]] for field in schema.split(", ")]
