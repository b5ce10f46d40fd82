"""Files that arrive: a stream of point tables, aggregated by tile as they come.

New capability beside the batch operators: tiles seen in a micro-batch are written as a batch, so that late files add
rows for their tiles and nothing is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "pid long, x double, y double, z double"


def tile_counts(points: DataFrame, size: float) -> DataFrame:
    """i, j, k, n_points and the mean of a stream or a table, by cubes from the origin."""
    cells = [F.floor(F.col(a) / size).cast("long").alias(c) for a, c in zip("xyz", "ijk", strict=True)]
    return points.groupBy(*cells).agg(F.count("*").alias("n_points"), *[F.avg(a).alias(a) for a in "xyz"])


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, size: float, files_per_batch: int = 100) -> StreamingQuery:
    """Read Parquet files that arrive below source, append each micro-batch's tiles to target, until what is there has
    been read."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        tile_counts(batch, size).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(batches: DataFrame) -> DataFrame:
    """i, j, k, n_points and the mean over all batches that watch() has written."""
    mean = lambda a: (F.sum(F.col(a) * F.col("n_points")) / F.sum("n_points")).alias(a)
    return batches.groupBy(*"ijk").agg(F.sum("n_points").alias("n_points"), *[mean(a) for a in "xyz"])
