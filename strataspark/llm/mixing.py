"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is queued twice (two passes over the source, in one order shuffled by the MD5 of its id).
Its virtual finish time is the number of source tokens up to its end, divided by the source's target. The mix is
the prefix of the order by finish time that fits the total budget; documents of equal finish time stay or go
together.

Prefix sums are taken in two levels, so that neither a hot source nor the whole table meets in one task: within
(source, slot of the shuffle key), and over slots, of which there is a fixed number. The global order is cut in the
same way, over a fixed number of ranges of finish time, of which only the one that holds the cut is sorted.

Defined cases: a null text has size 0; sizes of 0 take nothing; a null source is a source, last in order; repeated
rows each count; null doc_ids share one shuffle key; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.llm.base import carried, carry, count_words, materialize

#: Weights of the sources in order, repeating. Fixed values.
WEIGHTS = (5, 2, 1)
#: Sources up to which their one row each is broadcast; Spark joins more by a shuffle that it may split.
MOST_BROADCAST = 100_000


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> also rank, weight, target: share of all sizes, split by weight, at most `most` times
    the source's size, the excess going to the others by weight.

    With caps sorted by cap/weight, the first k are capped, where k is the least number at which the level of the
    rest stays under the next cap; from there on levels only fall. One row a source.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    )
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    below = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    held = levels.withColumn("found", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return held.select("source", "source_size", "rank", "weight", F.coalesce(F.least("cap", F.col("found") * F.col("weight")), F.col("cap")).alias("target"), "budget")


def _queued(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", *[c for c in keep if c not in ("doc_id", "source")], count_words(F.col("text")).alias("size"), key.alias("key"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, slot_digits: int = 3, ranges: int = 2048, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns named in keep, size, source_size, target, taken; a kept column of a
    name that the result has gives way."""
    made = ("size", "source_size", "target", "taken")
    others = [c for c in keep if c not in ("doc_id", "source")]
    if not others:
        return _mixed(docs, share, most, weights, slot_digits, ranges, keep)
    packed = carry(docs, "doc_id", "source", "text", columns=["doc_id", "source", "text", *others])
    inner = tuple(c for c in packed.columns if c != "text") + (("text",) if "text" in others else ())
    return carried(_mixed(packed, share, most, weights, slot_digits, ranges, inner), ["doc_id", *[c for c in keep if c != "doc_id"]], ("doc_id", "source", "text"), *made)


def _mixed(docs: DataFrame, share: float, most: float, weights: tuple[int, ...], slot_digits: int, ranges: int, keep: tuple[str, ...]) -> DataFrame:
    """The mix.

    Within a source the mix takes a prefix of the shuffled order in either pass, so a source's part is told by the
    last document taken in each: texts and other kept columns are joined to one row a source and never shuffled.
    """
    slim = materialize(_queued(docs)).withColumn("slot", F.substring("key", 1, slot_digits))
    slot_sums = slim.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_sums.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
    aims = materialize(targets(slot_sums.groupBy("source").agg(F.sum("slot_size").alias("source_size")), share, most, weights))
    # one row for each source and slot: at most sources x slots
    plan = starts.alias("s").join(aims.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select(F.col("s.source").alias("p_source"), F.col("s.slot").alias("p_slot"), "slot_start", "source_size", "target", "budget")
    within = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    some = (F.col("target") > 0) & (F.col("size") > 0)
    timed = (
        slim.withColumn("within", F.sum("size").over(within))
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slot") == F.col("p_slot")))
        .withColumn("finish", F.col("slot_start") + F.col("within"))
        .where(some)
        .select("source", F.struct("key", "doc_id", "size").alias("place"), "size", "budget", (F.col("finish") / F.col("target")).alias("v0"), ((F.col("finish") + F.col("source_size")) / F.col("target")).alias("v1"))
    )
    timed = materialize(timed)
    # finish times up to 1 always fit: each source then has at most its target
    part = F.when(F.col("v") <= 1, F.lit(0)).otherwise(F.least(F.lit(ranges), F.ceil((F.col("v") - 1) * ranges)).cast("int"))
    passes = timed.select("size", "budget", F.explode(F.array("v0", "v1")).alias("v")).withColumn("part", part)
    upto = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = passes.groupBy("part").agg(F.sum("size").alias("part_size"), F.max("budget").alias("budget"), F.max("v").alias("part_v")).withColumn("upto", F.sum("part_size").over(upto))
    slack = F.lit(1e-6)
    edges = parts.agg(  # one row: the first range that does not fit whole, and what the ranges before it hold
        F.min(F.when(F.col("upto") > F.col("budget") + slack, F.col("part"))).alias("cut_part"),
        F.max(F.when(F.col("upto") <= F.col("budget") + slack, F.col("upto"))).alias("sure"),
        F.max(F.when(F.col("upto") <= F.col("budget") + slack, F.col("part_v"))).alias("sure_v"),
    )
    inside = Window.partitionBy().orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peers = passes.join(F.broadcast(edges), F.col("part") == F.col("cut_part")).groupBy("v").agg(F.sum("size").alias("size"), F.max("budget").alias("budget"), F.max("sure").alias("sure"))
    last = peers.withColumn("upto", F.coalesce(F.col("sure"), F.lit(0)) + F.sum("size").over(inside)).where(F.col("upto") <= F.col("budget") + slack).agg(F.max("v").alias("last_v"))
    cut = edges.crossJoin(last).select(F.greatest("sure_v", "last_v").alias("cut_v"))  # one row
    reached = timed.crossJoin(F.broadcast(cut)).groupBy("source").agg(F.max(F.when(F.col("v0") <= F.col("cut_v"), F.col("place"))).alias("last0"), F.max(F.when(F.col("v1") <= F.col("cut_v"), F.col("place"))).alias("last1"))
    ends = materialize(aims.alias("a").join(reached.alias("r"), F.col("a.source").eqNullSafe(F.col("r.source")), "left").select(F.col("a.source").alias("e_source"), "source_size", "target", "last0", "last1"))
    if ends.count() <= MOST_BROADCAST:
        ends = F.broadcast(ends)
    rows = slim if set(keep) <= {"doc_id", "source"} else _queued(docs, keep)
    place = F.struct("key", "doc_id", "size")
    took = lambda last: F.when((F.col("target") > 0) & (place <= F.col(last)), F.col("size")).otherwise(F.lit(0))
    return rows.join(ends, F.col("source").eqNullSafe(F.col("e_source"))).select("doc_id", *[c for c in keep if c != "doc_id"], "size", "source_size", "target", (took("last0") + took("last1")).cast("long").alias("taken"))


#: The same for DuckDB.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, budget, coalesce(least(cap, weight * (SELECT max(level) FROM l WHERE level * weight <= cap)), cap) AS target FROM l),
f AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size RANGE UNBOUNDED PRECEDING) AS finish
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, CASE WHEN target > 0 AND size > 0 THEN finish / target END AS v0,
             CASE WHEN target > 0 AND size > 0 THEN (finish + source_size) / target END AS v1 FROM f),
p AS (SELECT v0 AS v, size, budget FROM v WHERE v0 IS NOT NULL UNION ALL SELECT v1, size, budget FROM v WHERE v1 IS NOT NULL),
c AS (SELECT max(v) AS cut_v FROM (SELECT v, budget, sum(size) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto FROM p) WHERE upto <= budget + 1e-6)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN v0 <= cut_v THEN size ELSE 0 END) + (CASE WHEN v1 <= cut_v THEN size ELSE 0 END))::BIGINT AS taken
FROM v CROSS JOIN c
"""
