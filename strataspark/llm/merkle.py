"""A manifest of a data set as a Merkle tree, with a proof for every row.

Leaves are hashes of rows. Those of one source, in order of doc_id, are joined three at a time until one is left, the
source's subroot; the subroots, in order of source, are joined in the same way to the root.

Bottom-up, every level is a table of nodes, written to the shared folder with the digests of its nodes' children.
Top-down, each level is joined to its parents once: a child puts the siblings that it finds with its parent in front of
the proof that the parent has inherited. A node has three children at most, so no group is larger, whatever a source
holds; a leaf's place within its source comes from a range sort and the row counts of its partitions, not from a window
over the source. Texts are read once and never shuffled.

Defined cases: a null field has its own mark, which no value has; rows of a null doc_id come first in their source, a
null source first of all; rows of equal doc_id are in order of their hashes, so repeated rows are neighbours; an empty
table gives an empty manifest. Columns other than the five that are hashed are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.base import Store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node. Fixed value.
WIDTH = 3
#: Rows of one partition number below this place in monotonically_increasing_id(). Fixed value.
_PLACES = 1 << 33
_STEPS = "array<struct<before: binary, after: binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _join(*digests: Column) -> Column:
    """Digest of digests, which are hashed as hexadecimal text."""
    return F.unhex(F.sha2(F.concat(*map(_hex, digests)).cast("binary"), 256))


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row: every field as its length in bytes and its value."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(fields[f]) for f in FIELDS]).cast("binary"), 256))


def _placed(leaves: DataFrame, store: Store, parts: int) -> DataFrame:
    """leaves (grp, doc_id, node, ...) with idx, the place in the group by (doc_id, node), and n, the group's size."""
    order = ["grp", F.col("doc_id").asc_nulls_first(), "node"]
    # rows of equal keys are dealt apart by the last one: a group of copies may be as large as any
    ranged = leaves.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_salt").sortWithinPartitions(*order, "_salt")
    rows = store.put(ranged.drop("_salt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.floor(F.col("_at") / _PLACES)))
    runs = rows.groupBy("grp", "_part").agg(F.count("*").alias("many"), F.min("_at").alias("first"))
    whole = runs.groupBy("grp").agg(F.sum("many").alias("n"), F.sort_array(F.collect_list(F.struct("_part", "many", "first"))).alias("runs"))  # one entry a partition
    # where each run of a group begins: an entry a partition, summed in order
    begun = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<bigint>").alias("starts")), lambda acc, r: F.struct((acc["upto"] + r["many"]).alias("upto"), F.concat(acc["starts"], F.array(acc["upto"])).alias("starts")))["starts"]
    starts = whole.select("grp", "n", F.explode(F.arrays_zip("runs", begun.alias("starts"))).alias("r")).select("grp", "n", F.col("r.runs._part").alias("_part"), F.col("r.runs.first").alias("first"), F.col("r.starts").alias("start"))
    return rows.join(starts, ["grp", "_part"]).withColumn("idx", F.col("_at") - F.col("first") + F.col("start")).drop("_at", "_part", "first", "start")


def _levels(leaves: DataFrame, store: Store, most: int) -> list[DataFrame]:
    """Levels above the leaves (grp, idx, n, node, children), as many as a group of `most` leaves needs. A group of one
    node does not go up."""
    levels, below = [], leaves
    while most > 1:
        most = -(-most // WIDTH)
        up = below.where("n > 1").groupBy("grp", F.floor(F.col("idx") / WIDTH).alias("parent")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("c"))  # WIDTH entries at most
        children = F.transform("c", lambda x: x["node"])
        level = up.select("grp", F.col("parent").alias("idx"), F.ceil(F.col("n") / WIDTH).alias("n"), children.alias("children"))
        node = F.unhex(F.sha2(_hex(F.aggregate("children", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))).cast("binary"), 256))
        below = store.put(level.withColumn("node", node))
        levels.append(below)
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp, node: the one node that is left of each group."""
    tops = leaves.where("n = 1").select("grp", "node")
    for level in levels:
        tops = tops.unionByName(level.where("n = 1").select("grp", "node"))
    return tops


def _push(rows: DataFrame, parents: DataFrame | None, inherited: DataFrame, keep: list[str]) -> DataFrame:
    """rows with steps and subroot. A top node has those of its group; any other one puts its siblings in front of
    what its parent has."""
    top = rows.where("n = 1").join(inherited, "grp").select(*keep, "subroot", "steps")
    if parents is None:
        return top
    up = parents.select("grp", F.col("idx").alias("_parent"), F.col("children").alias("_run"), "subroot", "steps")
    at = F.pmod("idx", F.lit(WIDTH)).cast("int")
    glue = lambda part: F.aggregate(part, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))
    step = F.struct(glue(F.slice("_run", F.lit(1), at)).alias("before"), glue(F.slice("_run", at + 2, F.lit(WIDTH))).alias("after"))
    lower = rows.where("n > 1").withColumn("_parent", F.floor(F.col("idx") / WIDTH)).join(up, ["grp", "_parent"])
    return lower.select(*keep, "subroot", F.concat(F.array(step), "steps").cast(_STEPS).alias("steps")).unionByName(top)


def _proved(leaves: DataFrame, levels: list[DataFrame], inherited: DataFrame, store: Store, keep: list[str]) -> DataFrame:
    """leaves (the columns in keep) with steps and subroot, pushed down through the levels."""
    parents = None
    for level in reversed(levels):
        parents = store.put(_push(level, parents, inherited, ["grp", "idx", "children"]))
    return _push(leaves, parents, inherited, keep)


def proofs(leaves: DataFrame, store: Store, parts: int) -> DataFrame:
    """leaves (grp string not null, doc_id, node, more) -> these, subroot, root and steps: for each level upwards the
    siblings before and after, as digests put together.

    parts: partitions of the range sort.
    """
    placed = store.put(_placed(leaves, store, parts))
    most = placed.agg(F.max("n")).first()[0]
    if most is None:
        return leaves.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("subroot", "binary"), ("root", "binary"), ("steps", _STEPS))]).limit(0)
    levels = _levels(placed, store, most)
    tops = store.put(_tops(placed, levels))
    # the subroots are the leaves of one more tree, whose only group is that of all sources
    sources = store.put(_placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("doc_id"), "node"), store, parts))
    upper = _levels(sources, store, sources.agg(F.max("n")).first()[0])
    root = _tops(sources, upper).select(F.col("node").alias("root"))  # one row
    none = F.array().cast(_STEPS).alias("steps")
    at_top = _tops(sources, upper).select("grp", F.lit(None).cast("binary").alias("subroot"), none)
    above = _proved(sources, upper, at_top, store, ["doc_id", "node"])
    inherited = store.put(above.select(F.col("doc_id").alias("grp"), F.col("node").alias("subroot"), "steps"))
    return _proved(placed, levels, inherited, store, leaves.columns).crossJoin(F.broadcast(root))


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(steps, node, lambda acc, s: F.unhex(F.sha2(_hex(F.concat(s["before"], acc, s["after"])).cast("binary"), 256)))


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(_hex(F.aggregate(steps, F.lit(b"").cast("binary"), lambda acc, s: F.concat(acc, s["before"], s["after"]))).cast("binary"), 256)


def group_of(source: Column) -> Column:
    """A source as a group's name: the null source sorts before all others, which keep their order by bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def manifest(docs: DataFrame, store: Store, more: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root (digests) and steps of every row; more: further columns made of a row, which
    are carried along. The tables below `store` have to stay until the result is read."""
    extra = more or {}
    rows = docs.select(F.col("doc_id"), group_of(F.col("source")).alias("grp"), leaf({f: F.col(f) for f in FIELDS}).alias("node"), *[c.alias(k) for k, c in extra.items()])
    leaves = store.put(rows)
    spark: SparkSession = docs.sparkSession
    proved = proofs(leaves, store, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
    return proved.select("doc_id", source.alias("source"), F.col("node").alias("leaf"), "subroot", "root", "steps", *extra)


def tampered(docs: DataFrame) -> Column:
    """The digest of each row as a reader has it where line ends were lost: every second doc_id by its CRC has none in
    its text."""
    lost = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))
    fields = {f: F.col(f) for f in FIELDS}
    changed = leaf(fields | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    return F.when(lost & F.contains(F.col("text"), F.lit("\n")), changed)


def report(docs: DataFrame, store: Store) -> DataFrame:
    """One row a document: its leaf, the roots, its proof, and whether the row that a reader has is proved by it."""
    kept = manifest(docs, store, {"changed": tampered(docs)})
    folded = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    return kept.select("doc_id", *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("_folded")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", _hex(F.col("_folded")).alias("folded_root"), (_hex(F.col("_folded")) == F.col("root")).alias("verified")
    )


#: The same for DuckDB, whose lists hold a node's digests level by level.
REPORT_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp,
         (coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
          || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
         list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + coalesce(length(doc_id::VARCHAR), 0)), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
d AS (SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
                  ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS had FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
up AS (
  SELECT 0 AS lvl, grp, idx, n, leaf AS node, NULL::VARCHAR[] AS run FROM placed
  UNION ALL
  SELECT lvl + 1, grp, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)), list(node ORDER BY idx) FROM up WHERE n > 1 GROUP BY lvl, grp, idx // 3),
subroots AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, n, subroot AS node, NULL::VARCHAR[] AS run FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)), list(node ORDER BY idx) FROM top WHERE n > 1 GROUP BY lvl, idx // 3),
root AS (SELECT node AS root FROM top WHERE n = 1),
walk AS (
  SELECT 0 AS lvl, p.doc_id, p.grp, p.idx, p.n, p.leaf, p.had AS folded, '' AS proof, row_number() OVER () AS rid FROM placed p
  UNION ALL
  SELECT w.lvl + 1, w.doc_id, w.grp, w.idx // 3, (w.n + 2) // 3, w.leaf,
         sha256(list_aggregate(list_transform(u.run, lambda x, i: CASE WHEN i - 1 = w.idx % 3 THEN w.folded ELSE x END), 'string_agg', '')),
         w.proof || coalesce(list_aggregate(list_filter(u.run, lambda x, i: i - 1 <> w.idx % 3), 'string_agg', ''), ''), w.rid
  FROM walk w JOIN up u ON u.lvl = w.lvl + 1 AND u.grp = w.grp AND u.idx = w.idx // 3 WHERE w.n > 1),
above AS (
  SELECT 0 AS lvl, w.doc_id, w.leaf, s.subroot, s.idx, s.n, w.folded, w.proof, w.rid FROM walk w JOIN subroots s ON s.grp = w.grp WHERE w.n = 1
  UNION ALL
  SELECT a.lvl + 1, a.doc_id, a.leaf, a.subroot, a.idx // 3, (a.n + 2) // 3,
         sha256(list_aggregate(list_transform(t.run, lambda x, i: CASE WHEN i - 1 = a.idx % 3 THEN a.folded ELSE x END), 'string_agg', '')),
         a.proof || coalesce(list_aggregate(list_filter(t.run, lambda x, i: i - 1 <> a.idx % 3), 'string_agg', ''), ''), a.rid
  FROM above a JOIN top t ON t.lvl = a.lvl + 1 AND t.idx = a.idx // 3 WHERE a.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM above CROSS JOIN root WHERE n = 1
"""
