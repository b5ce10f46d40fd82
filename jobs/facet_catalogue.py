"""A catalogue of the facets of a clustered point cloud, by joint set.

    python -m jobs.facet_catalogue POINTS OUTPUT [--config FILE] [--set NAME=JSON]

Reads a table of points that carry their joint set and facet, and writes, below OUTPUT,

* `facets`, Parquet by joint_id: plane, orientation, curvature, roughness and trace of every facet,
* `sets`, Parquet: a row for each joint set,
* `csv`, the facets in the columns of the facet CSV.

With `sets` in the configuration only those joint sets are read and replaced; the others stay as they are. Without it
the whole catalogue is replaced. Either way a rerun over the same points gives the same catalogue.

Points without an id, coordinate, joint set or facet are counted and left out; facets with fewer than `least_points`
points are left out as well. Facets whose points lie on a line have no plane, and null in what depends on one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, default_config, source
from strataspark.functions.vec import axis, dip_direction, orient, vec
from strataspark.operators.facets import farthest_twice
from strataspark.operators.graph import cut_lineage
from strataspark.operators.planes import fit_planes, residuals, with_orientation
from strataspark.sources.tables import write_facet_csv

KEY = ["joint_id", "facet_id"]


def catalogue(points: DataFrame, least_points: int = 3) -> DataFrame:
    """points (pid, joint_id, facet_id, x, y, z) -> a row a facet."""
    fits = with_orientation(fit_planes(points, KEY)).where(F.col("n") >= least_points)
    up = orient(vec("a", "b", "c"), axis(2))
    turned = fits.withColumn("_up", up.struct()).withColumn("d", F.when(F.col("c") < 0, -F.col("d")).otherwise(F.col("d")))
    planes = cut_lineage(turned.withColumn("dip_direction", dip_direction(up)).withColumns({k: F.col(f"_up.{v}") for k, v in zip("abc", "xyz", strict=True)}).drop("_up"))
    rough = residuals(points, planes, KEY).groupBy(*KEY).agg(F.stddev_pop("residual").alias("rms"), (F.max("residual") - F.min("residual")).alias("zrange"))
    whole = points.withColumn("facet", F.struct(*KEY))
    trace = farthest_twice(whole, "facet").select("facet.*", F.col("length").alias("trace_length"), F.col("v1").alias("trace_from"), F.col("v2").alias("trace_to"))
    joined = planes.join(rough, KEY, "left").join(trace, KEY, "left")
    return joined.select("joint_id", "facet_id", F.col("n").alias("n_points"), *[F.col(f"m{k}").alias(f"c{k}") for k in "xyz"], *"abcd", "dip", "dip_direction", "curvature", "rms", "zrange", "trace_length", "trace_from", "trace_to")


def by_set(facets: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    return facets.groupBy("joint_id").agg(F.count("*").alias("n_facets"), F.sum("n_points").alias("n_points"), mean("dip"), mean("rms"), mean("trace_length"), F.max("trace_length").alias("longest_trace"))


def run(spark: SparkSession, points: str, output: str, config: dict | None = None) -> dict:
    """Make the catalogue of the points below output; what was read and written, as logged."""
    config = config or default_config("facet_catalogue")
    rows, sets = source(spark, points, config), config.get("sets")
    whole = F.lit(True)
    for c in ("pid", "x", "y", "z", *KEY):
        whole &= F.col(c).isNotNull()
    wanted = F.col("joint_id").isin(sets) if sets is not None else F.lit(True)
    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("read"), F.count(F.when(whole & wanted, 1)).alias("used"), F.count(F.when(~whole, 1)).alias("incomplete"))
    used = cut_lineage(counted.where(whole & wanted))
    told = seen.get
    LOG.info("read %d points of %s, %d of them used, %d incomplete", told["read"], points, told["used"], told["incomplete"])
    out = catalogue(used, config.get("least_points", 3))
    writer = out.repartition("joint_id", F.pmod("facet_id", F.lit(16))).sortWithinPartitions(*KEY).write.mode("overwrite").partitionBy("joint_id")
    writer.option("partitionOverwriteMode", "static" if sets is None else "dynamic").parquet(f"{output}/facets")
    facets = read(spark, output)
    by_set(facets).coalesce(1).write.mode("overwrite").parquet(f"{output}/sets")  # a row a joint set
    write_facet_csv(facets.select(F.col("facet_id").alias("facet"), "joint_id", F.col("n_points").alias("n"), *"abcd", "dip", "rms", "trace_length", F.col("trace_from").alias("v1"), F.col("trace_to").alias("v2"), F.struct(*[F.col(f"c{k}").alias(k) for k in "xyz"]).alias("center"), F.col("a").isNotNull().alias("valid")), f"{output}/csv")
    wrote = facets.agg(F.count("*").alias("facets"), F.count_distinct("joint_id").alias("sets"), F.sum("n_points").alias("points")).first().asDict()
    LOG.info("%s/facets holds %d facets of %d joint sets, with %s points", output, wrote["facets"], wrote["sets"], wrote["points"])
    return told | wrote


def read(spark: SparkSession, output: str) -> DataFrame:
    """The facets that a run has written."""
    numbers = ", ".join(f"{c} double" for c in ("cx", "cy", "cz", *"abcd", "dip", "dip_direction", "curvature", "rms", "zrange", "trace_length"))
    schema = f"facet_id long, n_points long, {numbers}, trace_from long, trace_to long, joint_id long"
    return spark.read.schema(schema).parquet(f"{output}/facets")


if __name__ == "__main__":
    command_line("facet_catalogue", {"points": "table of points", "output": "folder of the catalogue"}, run)
