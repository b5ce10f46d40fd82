"""Points by the cluster they belong to, curvature splits, and the order in which seeds are taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLANE = ("a", "b", "c", "d")


def clusters(points: DataFrame, order: str) -> DataFrame:
    """js, cl, cluster_id, n and the plane of the cluster's first point. Clusters are numbered from 0 by their first
    place in the order; cl = -1 or null is noise. One shuffle of a row a cluster and task; the points stay."""
    grouped = points.where("cl <> -1").groupBy("js", "cl").agg(F.min(order).alias("_first"), F.count("*").alias("n"), F.min_by(F.struct(*PLANE), order).alias("_plane"))
    number = F.row_number().over(Window.orderBy("_first", "js", "cl")) - 1  # one row a cluster
    return grouped.select("js", "cl", number.alias("cluster_id"), "n", "_plane.*")


def curvature_split(points: DataFrame, threshold: float, curvature: str = "curvature") -> tuple[DataFrame, DataFrame]:
    """Points over the threshold, and all others (those without a curvature too)."""
    over = F.coalesce(F.col(curvature) > threshold, F.lit(False))
    return points.where(over), points.where(~over)


def seeds(polygons: DataFrame, by: str, key: str, area: str) -> DataFrame:
    """by, key, area, seed: polygons numbered from 1 within `by`, the largest first, ties by key, null areas last."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(F.col(area).desc_nulls_last(), key))
    return polygons.select(by, key, area, number.alias("seed"))


def not_empty(points: DataFrame, name: str = "") -> DataFrame:
    """points; an error if there are none. Reads up to its first row."""
    if points.isEmpty():
        raise ValueError(f"empty point cloud: {name}")
    return points


def large_clusters(labels: DataFrame, cluster: str, over: int = 100) -> DataFrame:
    """Rows of clusters of more than `over` rows; noise (null) goes. The counts are a row a cluster."""
    kept = labels.groupBy(cluster).count().where(F.col("count") > over).select(cluster)
    return labels.join(kept, cluster, "left_semi")
