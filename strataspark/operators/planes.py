"""Grouped linear algebra: moments, plane fits, curvature, roughness.

Moments are taken about the group's mean in two passes (the mean joined back, or a window over the group), so that
large coordinates cost no precision. Eigenvalues are closed-form expressions after the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.eig3 import with_eigen
from strataspark.functions.vec import V3, dip, strike, vec

XYZ = ("x", "y", "z")


def moments(df: DataFrame, by: list[str], axes: tuple[str, ...] = XYZ) -> DataFrame:
    """by -> n, mx, my, mz and central second moments cxx..czz divided by n.

    Spark's covariance aggregates update means and co-moments together (no difference of large sums) and combine
    partial results, so one shuffle of one row a group and task is enough."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    name = dict(zip("xyz", axes, strict=True))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{k}") for k, a in name.items()], *[F.covar_pop(name[p], name[q]).alias(f"c{p}{q}") for p, q in pairs])


def with_plane(m: DataFrame) -> DataFrame:
    """Moments with eigenvalues l1 <= l2 <= l3, the unit normal a, b, c, the offset d and curvature l1 / sum.
    The plane is null with fewer than three points or where they lie on a line."""
    e = with_eigen(m)
    fits = (F.col("n") >= 3) & (F.col("l2") > 1e-12 * F.greatest(F.col("l3"), F.lit(1e-12)))
    e = e.withColumns({name: F.when(fits, F.col(f"e1{k}")) for name, k in zip("abc", "xyz", strict=True)}).drop("e1x", "e1y", "e1z")
    total = F.col("l1") + F.col("l2") + F.col("l3")
    return e.withColumn("d", -(F.col("a") * F.col("mx") + F.col("b") * F.col("my") + F.col("c") * F.col("mz"))).withColumn("curvature", F.col("l1") / F.greatest(total, F.lit(1e-15)))


def fit_planes(df: DataFrame, by: list[str]) -> DataFrame:
    return with_plane(moments(df, by))


def normal() -> V3:
    return vec("a", "b", "c")


def with_orientation(planes: DataFrame) -> DataFrame:
    return planes.withColumn("dip", dip(normal())).withColumn("strike", strike(normal()))


def residuals(points: DataFrame, planes: DataFrame, by: list[str]) -> DataFrame:
    """points with the signed distance to their group's plane."""
    joined = points.join(planes.select(*by, "a", "b", "c", "d"), by)
    return joined.withColumn("residual", normal().dot(vec(*XYZ)) + F.col("d"))


def roughness(points: DataFrame, planes: DataFrame, by: list[str]) -> DataFrame:
    """Population deviation and range of the residuals, a row a group."""
    return residuals(points, planes, by).groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("residual").alias("rms"), (F.max("residual") - F.min("residual")).alias("zrange"))


def neighbour_planes(pairs: DataFrame, key: str = "pid", least: int = 3, cap: int | None = None, default: tuple[float, float, float] | None = None) -> DataFrame:
    """(key, n_x, n_y, n_z) pairs -> a plane for each key by its neighbourhood; curvature 0 under `least` points.

    default: the normal of points with fewer. cap: a sample of at most that many neighbours stands for a larger
    neighbourhood, those of the least hash of (key, n_key), so that it is the same in any run."""
    if cap is not None:
        by_hash = Window.partitionBy(key).orderBy(F.xxhash64(key, f"n_{key}"), f"n_{key}")
        pairs = pairs.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= cap).drop("_rank")
    planes = with_plane(moments(pairs, [key], ("n_x", "n_y", "n_z")))
    few = F.col("n") < least
    if default is not None:
        planes = planes.withColumns({c: F.when(few, F.lit(float(v))).otherwise(F.col(c)) for c, v in zip("abc", default, strict=True)})
    return planes.withColumn("curvature", F.when(few, 0.0).otherwise(F.col("curvature")))


def bic(rss: Column, n: Column, k: Column | int) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return n * F.log(F.greatest(rss / n, F.lit(1e-12))) + 3 * k * F.log(n)
