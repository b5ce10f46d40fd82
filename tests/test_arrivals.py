"""Files that arrive: two batches give what one read gives."""

from pyspark.sql import functions as F

from strataspark.streaming import arrivals


def test_batches_add_up(spark, tmp_path):
    source, target, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    points = spark.range(4000).select(F.col("id").alias("pid"), (F.col("id") % 97 / 3).alias("x"), (F.col("id") % 89 / 2 - 20).alias("y"), (F.col("id") % 7).cast("double").alias("z"))
    seen = []
    for first, last in ((0, 1500), (1500, 1501), (1501, 4000)):
        points.where(F.col("pid").between(first, last - 1)).coalesce(3).write.mode("append").parquet(source)
        for _ in range(2):  # the second run has nothing new
            arrivals.watch(spark, source, target, checkpoint, 5.0, files_per_batch=2).awaitTermination()
        seen.append(spark.read.parquet(target).agg(F.sum("n_points")).first()[0])
    assert seen == [1500, 1501, 4000]
    whole = {(r.i, r.j, r.k): (r.n_points, round(r.x, 9), round(r.y, 9)) for r in arrivals.tile_counts(points, 5.0).collect()}
    merged = arrivals.merged(spark.read.parquet(target))
    assert {(r.i, r.j, r.k): (r.n_points, round(r.x, 9), round(r.y, 9)) for r in merged.collect()} == whole and len(whole) > 50
