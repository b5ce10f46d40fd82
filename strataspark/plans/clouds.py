"""Point clouds, planes and disks projected from the driver's tables, for Spark and, as SQL text, for DuckDB.

The expressions are plain arithmetic that both engines evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (table, select list). Ids are unique: lineitem's are composed of its keys.
CLOUDS = {
    "pts": ("lineitem", "(l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pid, l_suppkey AS grp, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z"),
    "parts": ("part", "p_partkey AS pid, p_brand AS grp, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 17 AS DOUBLE) AS z"),
    "planes": ("supplier", "s_suppkey AS pid, s_nationkey AS grp, (s_suppkey * 7919 % 101) / 50.0e0 - 1 AS a, (s_suppkey * 104729 % 103) / 51.0e0 - 1 AS b, (s_suppkey * 1299709 % 107) / 53.0e0 - 1 AS c, s_acctbal / 1000 AS d"),
    "disks": ("customer", "c_custkey AS pid, c_nationkey AS grp, c_acctbal / 100 AS x, c_custkey * 37 % 1000 / 10.0e0 AS y, c_nationkey * 4.0e0 AS z, (c_custkey * 7919 % 101) / 50.0e0 - 1 AS a, (c_custkey * 104729 % 103) / 51.0e0 - 1 AS b, (c_custkey * 1299709 % 107) / 53.0e0 - 1 AS c, 1 + c_custkey % 7 / 2.0e0 AS ra, 1 + c_custkey % 3 / 2.0e0 AS rb"),
    "edges": ("orders", "o_custkey % 997 AS a, o_orderkey % 991 AS b"),
    "sparse_edges": ("customer", "c_custkey AS a, c_custkey * 7919 % 100003 % 5000 AS b"),
    "runs": ("events", "event_id, concat('Plane1_Gno', CAST(event_id * 7 % 6 * 20 AS VARCHAR(9)), '_GRID', CAST(event_id * 11 % 6 * 2 AS VARCHAR(9)), CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('_sin', CAST(event_id * 13 % 6 * 20 AS VARCHAR(9))) END, '_Ben', CAST(event_id * 17 % 101 AS VARCHAR(9)), '.ply') AS file, value AS ratio"),
}


def cloud(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = CLOUDS[name]
    return spark.sql(f"SELECT {columns} FROM {{rows}}", rows=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def sql(*names: str) -> str:
    """WITH list of the clouds."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {CLOUDS[n][1]} FROM {CLOUDS[n][0]})" for n in names)


def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, grp, x, y, z: the first three components of the embeddings, as unit vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pid"), F.col("label").alias("grp"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)])
    n = F.sqrt(F.col("e0") * F.col("e0") + F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2"))
    return e.select("pid", "grp", *[(F.col(f"e{i}") / n).alias(a) for i, a in enumerate("xyz")])


NORMALS_SQL = "nrm AS (SELECT pid, grp, e0 / n AS x, e1 / n AS y, e2 / n AS z FROM (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS n FROM (SELECT vec_id AS pid, label AS grp, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2 FROM embeddings)))"
