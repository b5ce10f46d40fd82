"""Lines that many documents repeat, found with an index of line hashes that grows by batches.

The index is a list of sorted runs, in levels, as in a log-structured merge tree. A run is a bucketed table of line
hashes, sorted within its buckets, with the number of documents that hold the line and the largest doc_id among them.
A batch of documents is counted by line, merge-anti-joined with the runs, which leaves out lines that a run has settled
(enough documents, and none later in this batch), and what is left becomes a run of level 0. When a level holds
`fanout` runs, they are merged into one run of the next level. All runs have the same buckets, so neither the join with
a batch nor a merge shuffles a run again.

With batches that go from large doc_ids to small ones a line is settled as soon as it has been seen often enough; in
any other order the index gives the same counts, only with longer runs.

Texts are read twice: for the hashes of their lines, and to drop lines, where each text meets the places of the lines
that it loses. Hashes have 128 bits. A line that a third of all documents hold is one row of each batch's counts; where
the lines of documents meet the index, Spark splits such a key, as the side that is split is a plain table.

Defined cases: every row is a document, so a repeated row counts as a further one; a null text is one empty line; a null
doc_id is less than all others, and where all documents of a line have none, all keep it; an empty table gives an empty
result. Extra columns go through dedup() whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.base import LOWER, UPPER, Store, carried, carry, let, remove, shared_folder

#: What is stripped from both ends of a line: space and the control characters from tab to carriage return. Fixed value.
BLANKS = " \t\n\x0b\x0c\r"
_KEY = ("h1", "h2")
_TEXT = ("t1", "t2")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased. Where all characters are ASCII, lower() does just that, and
    faster."""
    bare = F.btrim(line, F.lit(BLANKS))
    return let(bare, lambda b: F.when(F.octet_length(b) == F.char_length(b), F.lower(b)).otherwise(F.translate(b, UPPER, LOWER)))


def _hashes(value: Column, names: tuple[str, str] = _KEY) -> list[Column]:
    """128 bits of a value: two hashes of different seeds."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit("line"), value).alias(names[1])]


def _identity() -> list[Column]:
    """128 bits of a document, its id and text: what is decided for it holds for its repetitions too."""
    return [F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias(_TEXT[0]), F.xxhash64(F.lit("text"), F.col("doc_id").isNull(), "doc_id", "text").alias(_TEXT[1])]


def line_keys(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """t1, t2, doc_id, at, h1, h2, first: a row for each line whose key has least_chars code points; first is 1 for the
    first one of its key in the document, else 0."""
    numbered = F.transform(lines(F.col("text")), lambda line, i: F.struct(F.btrim(line, F.lit(BLANKS)).alias("line"), i.alias("at")))
    long_ones = F.filter(numbered, lambda x: F.char_length(x["line"]) >= least_chars)
    hashed = F.transform(long_ones, lambda x: let(key_of(x["line"]), lambda k: F.struct(*_hashes(k), x["at"].alias("at"))))
    rows = docs.select("doc_id", *_identity(), F.array_sort(hashed).alias("keys"))
    same = lambda a, b: (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])
    first = F.transform("keys", lambda x, i: F.when((i > 0) & same(x, F.get("keys", F.greatest(i - 1, F.lit(0)))), 0).otherwise(1))
    return rows.select("doc_id", *_TEXT, F.inline(F.arrays_zip("keys", first.alias("first")))).select(*_TEXT, "doc_id", "keys.at", *[f"keys.{h}" for h in _KEY], "first")


def counted(keys: DataFrame) -> DataFrame:
    """h1, h2, n, last: documents of each line, and the largest doc_id among them."""
    return keys.groupBy(*_KEY).agg(F.sum("first").alias("n"), F.max("doc_id").alias("last"))


class Runs:
    """The index: runs by level. Its tables stay below the shared folder until drop()."""

    def __init__(self, spark: SparkSession, min_docs: int = 5, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.levels, self.many = shared_folder(spark, "line-runs"), {}, 0

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.many += 1
        rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.folder}/{self.many}").format("parquet").saveAsTable(name)
        return name

    def add(self, keys: DataFrame) -> None:
        """Take a batch of line_keys()."""
        fresh = counted(keys).alias("b")
        for name in self.names():
            settled = self.spark.table(name).where(F.col("n") >= self.min_docs).alias("r")
            same = (F.col("b.h1") == F.col("r.h1")) & (F.col("b.h2") == F.col("r.h2"))
            no_later = F.col("b.last").isNull() | (F.col("b.last") <= F.col("r.last"))
            fresh = fresh.join(settled.hint("merge"), same & no_later, "left_anti").alias("b")
        self.levels.setdefault(0, []).append(self._write(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(self.levels.pop(level), level + 1)
            level += 1

    def _merge(self, names: list[str], level: int) -> None:
        """Runs into one, of the level: two at a time by an outer merge join, which keeps their buckets."""
        merged = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*_KEY, F.col("n").alias("n_"), F.col("last").alias("last_")).hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))
            merged = merged.join(other, list(_KEY), "full").select(*_KEY, n.alias("n"), F.greatest("last", "last_").alias("last"))
        self.levels.setdefault(level, []).append(self._write(merged))
        for name in names:
            self._forget(name)

    def _forget(self, name: str) -> None:
        where = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, where)

    def names(self) -> list[str]:
        return [n for level in sorted(self.levels) for n in self.levels[level]]

    def compact(self) -> DataFrame:
        """h1, h2, n, last of all batches, from one run."""
        if len(self.names()) > 1:
            names, level = self.names(), max(self.levels) + 1
            self.levels.clear()
            self._merge(names, level)
        return self.spark.table(self.names()[0])

    def drop(self) -> None:
        for name in self.names():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels.clear()
        remove(self.spark, self.folder)


def _batches(docs: DataFrame, many: int) -> Column:
    """Number of a row's batch, by ranges of doc_id from large to small; the null doc_id is in the last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 1000)).first()[0] or []
    return sum((F.when(F.col("doc_id") > c, 0).otherwise(1) for c in cuts), F.lit(0))


def losses(docs: DataFrame, store: Store, least_chars: int = 40, min_docs: int = 5, batches: int = 4, runs: Runs | None = None) -> DataFrame:
    """t1, t2, places: for each document that loses lines, their numbers from 0.

    batches: how many the documents are taken in. runs: an index to go on with, which may hold earlier documents.
    """
    spark = docs.sparkSession
    index = runs or Runs(spark, min_docs)
    path = f"{store.folder}/lines"
    line_keys(docs, least_chars).withColumn("batch", _batches(docs, batches)).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(f"{', '.join(f'{c} long' for c in (*_TEXT, 'doc_id'))}, at int, h1 long, h2 long, first int, batch int").parquet(path)
    try:
        for k in range(batches):
            index.add(keys.where(F.col("batch") == k))
        often = index.compact().where(F.col("n") >= min_docs).select(*_KEY, "last")
        lost = keys.join(often, list(_KEY)).where(~F.col("doc_id").eqNullSafe(F.col("last")))
        return store.put(lost.groupBy(*_TEXT).agg(F.collect_set("at").alias("places")))  # a text's own lines at most
    finally:
        if runs is None:
            index.drop()


def _with_losses(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs with parts, kept (numbers of the lines that stay, null where all do)."""
    named = docs.select("*", *_identity())
    return named.join(lost, list(_TEXT), "left").drop(*_TEXT)


def _kept(text: Column, places: Column) -> Column:
    """The lines that stay, joined; linear in the number of lines."""
    joined = let(lines(text), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places), lambda i: F.get(parts, i)), "\n"))
    return F.when(places.isNull(), F.coalesce(text, F.lit(""))).otherwise(joined)


def dedup(docs: DataFrame, store: Store, **options) -> DataFrame:
    """docs with the lines dropped from text, all other columns as they are; a null text stays null. Options as of
    losses()."""
    packed = carry(docs, "doc_id", "text")
    out = _with_losses(packed, losses(docs.select("doc_id", "text"), store, **options))
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), _kept(F.col("text"), F.col("places"))))
    return carried(out, docs.columns, ("doc_id", "text"))


def report(docs: DataFrame, store: Store, **options) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256. Options as of losses()."""
    docs = docs.select("doc_id", "text")
    out = _with_losses(docs, losses(docs, store, **options))
    n_lines = F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"), F.sha2(_kept(F.col("text"), F.col("places")).cast("binary"), 256).alias("kept_sha256"))


#: The same for DuckDB.
REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
m AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.last AS gone FROM k LEFT JOIN often o ON o.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
