"""Tables of points and facets: the two TSV layouts, result CSVs, and the facet CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.analysis import first_seen

QFACET = ("X", "Y", "Z", "cluster_id", "subcluster_id", "facet_id", "A", "B", "C", "D")
#: Columns of the facet CSV. Fixed values.
FACET_COLUMNS = ("facet", "joint_id", "joint_cluster_id", "n", "a", "b", "c", "d", "dip", "strike", "type", "rms", "area", "polygon", "trace_length", "v1", "v2", "center", "ellip_a", "ellip_b", "block_id", "valid")


def read_dse(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, js, cl, a, b, c, d and cluster_id: (js, cl) numbered from 0 in order of first appearance; cl = -1 is
    noise and has none."""
    rows = spark.read.csv(path, sep="\t", schema="x double, y double, z double, js int, cl int, a double, b double, c double, d double")
    placed = rows.withColumn("_at", F.monotonically_increasing_id())  # rises with the place in the file
    numbers = first_seen(placed.where("cl <> -1").withColumn("k", F.struct("js", "cl")), "k", "_at")
    return placed.join(numbers.select(F.col("k.js").alias("js"), F.col("k.cl").alias("cl"), F.col("number").cast("int").alias("cluster_id")), ["js", "cl"], "left").drop("_at").select("x", "y", "z", "js", "cl", "a", "b", "c", "d", "cluster_id")


def qfacet(rows: DataFrame, order: str) -> DataFrame:
    """Rows of strings (QFACET's columns) as numbers, ids that do not parse as -1, and combined_id. Rows of no set
    (cluster_id -1) get their facets, numbered in order of first appearance, as sub-clusters (-1 without a facet), and
    the facet as combined id. Other rows keep their ids; their (cluster_id, subcluster_id) are numbered in order of first
    appearance, those without a sub-cluster have none."""
    missing = [c for c in QFACET if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    ids = ("cluster_id", "subcluster_id", "facet_id")
    clean = rows.select(order, *[F.col(c).try_cast("double").alias(c.lower()) for c in QFACET if c not in ids], *[F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(-1)).alias(c) for c in ids])
    loose = F.col("cluster_id") == -1
    facets = first_seen(clean.where(loose & (F.col("facet_id") >= 0)), "facet_id", order).select("facet_id", F.lit(-1).alias("cluster_id"), F.col("number").cast("int").alias("new"))
    pairs = first_seen(clean.where(~loose & (F.col("subcluster_id") != -1)).withColumn("k", F.struct("cluster_id", "subcluster_id")), "k", order).select("k.*", F.col("number").cast("int").alias("pair"))
    told = clean.join(facets, ["cluster_id", "facet_id"], "left").join(pairs, ["cluster_id", "subcluster_id"], "left")
    combined = F.when(loose, F.when(F.col("facet_id") >= 0, F.col("facet_id"))).otherwise(F.col("pair"))
    return told.withColumn("combined_id", combined).withColumn("subcluster_id", F.when(loose, F.coalesce("new", F.lit(-1))).otherwise(F.col("subcluster_id"))).drop("new", "pair")


def read_qfacet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True).withColumn("_at", F.monotonically_increasing_id())
    return qfacet(rows, "_at").drop("_at")


def facet_lines(points: DataFrame, order: str) -> DataFrame:
    """(order, line): the eleven columns of the facet pipeline as tab-separated text, numbers with nine decimals,
    absent planes as nan and absent ids as -1."""
    number = lambda c: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.9f", F.col(c)))
    ids = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("string")
    columns = [number("x"), number("y"), number("z"), ids("cluster_id"), ids("subcluster_id"), ids("facet_id"), number("a"), number("b"), number("c"), number("d"), number("curvature")]
    return points.select(order, F.concat_ws("\t", *columns).alias("line"))


def write_facets_tsv(points: DataFrame, path: str, order: str) -> None:
    """Text files in the order's ranges, each with the rows of its range."""
    facet_lines(points, order).repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def facet_csv(facets: DataFrame) -> DataFrame:
    """The facet attributes as text, structures and arrays as JSON; names that a table lacks are empty."""
    plain = ("double", "float", "int", "bigint", "string", "boolean", "smallint")
    kinds = dict(facets.dtypes)
    show = lambda c: F.lit(None).cast("string") if c not in kinds else F.col(c).cast("string") if kinds[c] in plain else F.to_json(c)
    return facets.select(*[show(c).alias(c) for c in FACET_COLUMNS])


def write_facet_csv(facets: DataFrame, path: str) -> None:
    facet_csv(facets).write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "file string, backend string, n_points long, threshold_m double, inliers long, inlier_ratio double, plane_a double, plane_b double, plane_c double, plane_d double, runtime_ms double"
    return spark.read.csv(path, header=True, schema=schema)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").option("header", True).csv(path)


def split_by_set(points: DataFrame, path: str, *keys: str) -> None:
    """Parquet files in a folder for each value of the keys."""
    points.write.mode("overwrite").partitionBy(*keys).parquet(path)
