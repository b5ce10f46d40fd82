"""Queries over cluster look-ups, curvature splits, seeds and pruned graphs, with the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators import lookup, pairs
from strataspark.plans.clouds import cloud, sql
from strataspark.plans.vectors import r

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


@query(
    sql("planes") + ", p AS (SELECT pid, grp % 7 AS js, CASE WHEN pid % 11 = 0 THEN -1 ELSE pid % 5 END AS cl, a, b, c, d FROM planes), g AS (SELECT js, cl, min(pid) AS f, count(*) AS n FROM p WHERE cl <> -1 GROUP BY js, cl) "
    "SELECT g.js, g.cl, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS cluster_id, n::BIGINT AS n, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(d, 6) + 0.0 AS d FROM g JOIN p ON p.pid = g.f"
)
def j12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of (js, cl), their numbers, sizes and first planes."""
    cl = F.when(F.col("pid") % 11 == 0, -1).otherwise(F.col("pid") % 5)
    told = lookup.clusters(cloud(spark, sf_dir, "planes").select("pid", (F.col("grp") % 7).alias("js"), cl.alias("cl"), *lookup.PLANE), "pid")
    return told.select("js", "cl", F.col("cluster_id").cast("long").alias("cluster_id"), "n", *[r(F.col(c), c) for c in lookup.PLANE])


@query(sql("pts") + " SELECT grp, sum(CASE WHEN abs(z - 5) > 3 THEN 1 ELSE 0 END)::BIGINT AS edge, sum(CASE WHEN abs(z - 5) > 3 THEN 0 ELSE 1 END)::BIGINT AS rest FROM pts GROUP BY grp")
def f2_curvature_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over a threshold and the others, counted for each group."""
    edge, rest = lookup.curvature_split(cloud(spark, sf_dir, "pts").select("grp", F.abs(F.col("z") - 5).alias("curvature")), 3.0)
    both = edge.select("grp", F.lit(1).alias("e")).unionByName(rest.select("grp", F.lit(0).alias("e")))
    return both.groupBy("grp").agg(F.sum("e").alias("edge"), F.sum(1 - F.col("e")).alias("rest"))


@query(sql("disks") + " SELECT grp, pid, round(ra * rb, 6) + 0.0 AS area, row_number() OVER (PARTITION BY grp ORDER BY ra * rb DESC, pid)::BIGINT AS seed FROM disks")
def t4_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks of each group in the order in which blocks take their seeds."""
    told = lookup.seeds(cloud(spark, sf_dir, "disks").withColumn("area", F.col("ra") * F.col("rb")), "grp", "pid", "area")
    return told.select("grp", "pid", r(F.col("area"), "area"), F.col("seed").cast("long").alias("seed"))


@query(sql("parts", "sparse_edges") + " SELECT pid AS node FROM parts WHERE pid IN (SELECT a FROM sparse_edges UNION SELECT b FROM sparse_edges)")
def f12_pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that some edge touches."""
    edges = cloud(spark, sf_dir, "sparse_edges").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return pairs.drop_isolated(cloud(spark, sf_dir, "parts").select(F.col("pid").alias("node")), edges)


@query(sql("pts") + " SELECT grp, count(*)::BIGINT AS n FROM pts WHERE grp % 13 <> 0 GROUP BY grp HAVING count(*) > 100")
def c8_large_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the clusters of more than a hundred points, groups divisible by 13 being noise."""
    points = lookup.not_empty(cloud(spark, sf_dir, "pts"), "pts")
    labels = points.select("pid", F.when(F.col("grp") % 13 != 0, F.col("grp")).alias("grp"))
    return lookup.large_clusters(labels, "grp").groupBy("grp").agg(F.count("*").alias("n"))
