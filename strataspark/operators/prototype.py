"""Measures of facets and directions: hemispheres, scores of points, fitted circles, traces in XY, common prisms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions import hull
from strataspark.functions.eig3 import with_eigen
from strataspark.functions.vec import vec
from strataspark.operators.graph import cut_lineage
from strataspark.operators.planes import moments, with_plane

XYZ = ("x", "y", "z")


def main_directions(normals: DataFrame, by: list[str]) -> DataFrame:
    """by, rx, ry, rz: the direction of the greatest second moment about the origin, which is the first right singular
    vector of each group's rows; its component of greatest magnitude is positive. Null where none is singled out.

    It is the least eigenvector of the matrix taken from its trace times the unit matrix."""
    square = lambda a, b: F.avg(F.col(a) * F.col(b))
    m = normals.groupBy(*by).agg(*[square(a, b).alias(f"m{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    turned = m.select(*by, (F.col("myy") + F.col("mzz")).alias("cxx"), (F.col("mxx") + F.col("mzz")).alias("cyy"), (F.col("mxx") + F.col("myy")).alias("czz"), *[(-F.col(f"m{p}")).alias(f"c{p}") for p in ("xy", "xz", "yz")])
    return with_eigen(turned).select(*by, *[F.col(f"e1{k}").alias(f"r{k}") for k in XYZ])


def to_hemisphere(normals: DataFrame, by: list[str]) -> DataFrame:
    """normals turned to the side of their group's main direction; as they are where there is none."""
    joined = normals.join(main_directions(normals, by), by)
    side = F.when(vec(*XYZ).dot(vec("rx", "ry", "rz")) < 0, -1.0).otherwise(1.0)
    return joined.select(*[F.col(c) * side if c in XYZ else F.col(c) for c in normals.columns]).toDF(*normals.columns)


def point_scores(neighbours: DataFrame, key: str = "pid") -> DataFrame:
    """(key, planarity, density, score): (l2 - l3) / l1 of the neighbourhood's moments, with l1 the greatest
    eigenvalue, plus the inverse mean distance. neighbours: (key, n_key, n_x, n_y, n_z, d2), the point itself not among
    them. A neighbourhood on a line or in one point has planarity 0."""
    fits = with_eigen(moments(neighbours, [key], ("n_x", "n_y", "n_z")))
    flat = F.when(F.col("l2") > 1e-12 * F.greatest(F.col("l3"), F.lit(1e-300)), (F.col("l2") - F.col("l1")) / F.col("l3")).otherwise(0.0)
    near = neighbours.groupBy(key).agg((1 / (F.avg(F.sqrt("d2")) + 1e-8)).alias("density"))
    return fits.select(key, flat.alias("planarity")).join(near, key).withColumn("score", F.col("planarity") + F.col("density"))


def circles(flat: DataFrame, by: str) -> DataFrame:
    """(by, cs, ct, radius): the circle of least squares of s^2 + t^2 - 2 (cs s + ct t) = q through each group of
    (by, s, t). Its normal equations take second and third moments about the mean, which one aggregation gives; points
    on a line have no circle."""
    mean = flat.groupBy(by).agg(F.avg("s").alias("ms"), F.avg("t").alias("mt"))
    near = flat.join(mean, by).select(by, "ms", "mt", (F.col("s") - F.col("ms")).alias("s"), (F.col("t") - F.col("mt")).alias("t"))
    s, t = F.col("s"), F.col("t")
    sums = {"ss": s * s, "st": s * t, "tt": t * t, "sz": s * (s * s + t * t), "tz": t * (s * s + t * t)}
    m = near.groupBy(by).agg(F.first("ms").alias("ms"), F.first("mt").alias("mt"), *[F.avg(e).alias(k) for k, e in sums.items()])
    det = F.col("ss") * F.col("tt") - F.col("st") * F.col("st")
    safe = F.when(det > 1e-12 * (F.col("ss") + F.col("tt")) * (F.col("ss") + F.col("tt")), det)
    u = (F.col("sz") * F.col("tt") - F.col("tz") * F.col("st")) / (2 * safe)
    v = (F.col("tz") * F.col("ss") - F.col("sz") * F.col("st")) / (2 * safe)
    return m.select(by, (F.col("ms") + u).alias("cs"), (F.col("mt") + v).alias("ct"), F.sqrt(u * u + v * v + F.col("ss") + F.col("tt")).alias("radius"))


def geometric_circles(flat: DataFrame, by: str, rounds: int = 8) -> DataFrame:
    """(by, cs, ct, radius): the circle of least squares of the points' distances to it, from circles() on by
    Gauss-Newton steps. A step is one aggregation; groups without an algebraic circle have none."""
    now = cut_lineage(circles(flat, by))
    for _ in range(rounds):
        at = flat.join(now, by)
        far = F.sqrt((F.col("s") - F.col("cs")) * (F.col("s") - F.col("cs")) + (F.col("t") - F.col("ct")) * (F.col("t") - F.col("ct")))
        seen = at.withColumn("_r", far).withColumn("_u", F.try_divide(F.col("cs") - F.col("s"), F.col("_r"))).withColumn("_v", F.try_divide(F.col("ct") - F.col("t"), F.col("_r")))
        # residuals r - mean(r) have the derivatives u - mean(u), v - mean(v): covariances are their normal equations
        cov = {"uu": ("_u", "_u"), "uv": ("_u", "_v"), "vv": ("_v", "_v"), "ur": ("_u", "_r"), "vr": ("_v", "_r")}
        m = seen.groupBy(by).agg(F.first("cs").alias("cs"), F.first("ct").alias("ct"), *[F.covar_pop(a, b).alias(k) for k, (a, b) in cov.items()])
        det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
        ok = det > 1e-14
        du = F.when(ok, (F.col("ur") * F.col("vv") - F.col("vr") * F.col("uv")) / F.when(ok, det)).otherwise(0.0)
        dv = F.when(ok, (F.col("vr") * F.col("uu") - F.col("ur") * F.col("uv")) / F.when(ok, det)).otherwise(0.0)
        now = cut_lineage(m.select(by, (F.col("cs") - du).alias("cs"), (F.col("ct") - dv).alias("ct"), F.lit(None).cast("double").alias("radius")))
    at = flat.join(now.drop("radius"), by)
    far = F.sqrt((F.col("s") - F.col("cs")) * (F.col("s") - F.col("cs")) + (F.col("t") - F.col("ct")) * (F.col("t") - F.col("ct")))
    return at.groupBy(by).agg(F.first("cs").alias("cs"), F.first("ct").alias("ct"), F.avg(far).alias("radius"))


def clip_line(px: Column, py: Column, dx: Column, dy: Column, corners: Column) -> Column:
    """struct(low, high): the parameters between which the line p + k d is inside a convex polygon, an array of
    struct(x, y) in counter-clockwise order; null where it misses it, or touches it in a corner alone."""
    n = F.size(corners)
    pairs = F.arrays_zip(corners.alias("p"), F.concat(F.slice(corners, 2, n), F.slice(corners, 1, 1)).alias("q"))
    # inside the half-plane of an edge: w + k * v >= 0
    ex, ey = (lambda e: e["q"]["x"] - e["p"]["x"]), (lambda e: e["q"]["y"] - e["p"]["y"])
    w = lambda e: ex(e) * (py - e["p"]["y"]) - ey(e) * (px - e["p"]["x"])
    v = lambda e: ex(e) * dy - ey(e) * dx
    start = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def step(a: Column, e: Column) -> Column:
        cut = F.try_divide(-w(e), v(e))
        low = F.when(v(e) > 0, F.greatest(a["low"], cut)).when((v(e) == 0) & (w(e) < 0), F.lit(float("inf"))).otherwise(a["low"])
        high = F.when(v(e) < 0, F.least(a["high"], cut)).otherwise(a["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    cut = F.when(n > 2, F.aggregate(pairs, start, step))
    return F.when((cut["high"] - cut["low"] > 1e-12) & (cut["low"] > float("-inf")) & (cut["high"] < float("inf")), cut)


def xy_traces(points: DataFrame, by: str) -> DataFrame:
    """A row a facet: by, n, a, b, c, d, dip, dip_direction, and its trace in XY, the part inside the facet's hull of the
    line where its plane meets z = 0: x1, y1, x2, y2, length. The trace is null where the line misses the hull.

    dip is acos|c| and dip_direction atan2(b, a) of the normal, in degrees."""
    from strataspark.operators.facets import hull_polygons

    planes = cut_lineage(with_plane(moments(points, [by])).select(by, "n", "a", "b", "c", "d"))
    polygons = cut_lineage(hull_polygons(points.select(by, F.col("x").alias("s"), F.col("y").alias("t")), by))
    ring = F.transform(F.arrays_zip("s", "t"), lambda e: F.struct(e["s"].alias("x"), e["t"].alias("y")))
    joined = planes.join(polygons.select(by, ring.alias("ring")), by)
    flat = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    safe = F.when(flat > 1e-12, flat)
    px, py, dx, dy = -F.col("d") * F.col("a") / safe, -F.col("d") * F.col("b") / safe, -F.col("b") / F.sqrt(safe), F.col("a") / F.sqrt(safe)
    steps = joined.withColumns({"_px": px, "_py": py, "_dx": dx, "_dy": dy})
    steps = cut_lineage(steps.withColumn("_k", F.when(F.col("_px").isNotNull(), clip_line(*[F.col(c) for c in ("_px", "_py", "_dx", "_dy")], F.col("ring")))))
    at = lambda k, p, d: F.col(p) + F.col(d) * F.col(f"_k.{k}")
    return steps.select(
        by, "n", *"abcd", F.degrees(F.acos(F.least(F.abs("c"), F.lit(1.0)))).alias("dip"), F.pmod(F.degrees(F.atan2("b", "a")), F.lit(360.0)).alias("dip_direction"),
        at("low", "_px", "_dx").alias("x1"), at("low", "_py", "_dy").alias("y1"), at("high", "_px", "_dx").alias("x2"), at("high", "_py", "_dy").alias("y2"), (F.col("_k.high") - F.col("_k.low")).alias("length"),
    )


def _meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The intersection of two convex polygons in counter-clockwise order; without corners where they are apart."""
    for a, b in zip(q, np.roll(q, -1, axis=0), strict=True):
        if not len(p):
            return p
        side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
        kept = []
        for i in range(len(p)):
            j = (i + 1) % len(p)
            if side[i] >= 0:
                kept.append(p[i])
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                kept.append(p[i] + (p[j] - p[i]) * (side[i] / (side[i] - side[j])))
        p = np.array(kept).reshape(-1, 2)
    return p


def common_prisms(disks: DataFrame, by: str, corners: int = 64, parts: int = 16) -> DataFrame:
    """(by, n, low, high, s, t, area): the polygon that all disks (by, x, y, z, r) of a group share in XY, and the range
    of their z. A disk is a polygon of `corners` corners. Disks without a common part have an empty polygon.

    The intersection is taken within salted parts of a group first, then of the parts: it does not depend on the order,
    and a part's polygon has no more corners than its disks have edges on it."""

    def ring(x: float, y: float, r: float) -> np.ndarray:
        turn = np.arange(corners) * (2 * math.pi / corners)
        return np.column_stack([x + r * np.cos(turn), y + r * np.sin(turn)])

    def fold(polygons) -> np.ndarray:
        shared = None
        for p in polygons:
            shared = p if shared is None else _meet(shared, p)
        return shared if len(shared) > 2 else np.zeros((0, 2))

    def of_disks(pdf: pd.DataFrame) -> pd.DataFrame:
        shared = fold(ring(*row) for row in pdf[["x", "y", "r"]].itertuples(index=False))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(pdf)], "low": [pdf["z"].min()], "high": [pdf["z"].max()], "s": [shared[:, 0].tolist()], "t": [shared[:, 1].tolist()]})

    def of_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        shared = fold(np.column_stack([s, t]).reshape(-1, 2) for s, t in zip(pdf["s"], pdf["t"], strict=True))
        area = abs(hull.area_centroid(shared)[0]) if len(shared) > 2 else 0.0
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [int(pdf["n"].sum())], "low": [pdf["low"].min()], "high": [pdf["high"].max()], "s": [shared[:, 0].tolist()], "t": [shared[:, 1].tolist()], "area": [area]})

    kind = dict(disks.dtypes)[by]
    schema = f"{by} {kind}, n long, low double, high double, s array<double>, t array<double>"
    known = disks.where("x IS NOT NULL AND y IS NOT NULL AND r IS NOT NULL")
    salted = known.select(by, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "r")]).withColumn("_part", F.pmod(F.xxhash64("x", "y", "z", "r"), F.lit(parts)))
    return salted.groupBy(by, "_part").applyInPandas(lambda pdf: of_disks(pdf), schema).groupBy(by).applyInPandas(of_parts, f"{schema}, area double")
