"""RANSAC planes with hypotheses from a linear congruential generator, so that any engine can replay the draws.

Hypotheses are rows (group, iteration) with three ranks; ranks meet points by an equi-join, every hypothesis is then
counted against its group's points in one pass: the points of a group carry all hypotheses' planes as one array of
fixed length (iterations), and the counts are sums of arrays' entries by position.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.vec import vec_of
from strataspark.operators.graph import cut_lineage
from strataspark.operators.planes import bic, fit_planes

XYZ = ("x", "y", "z")
#: The generator: next = (A * this + C) mod M. Fixed values.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648


def lcg(n: Column) -> Column:
    return F.pmod(n * F.lit(LCG_A).cast("long") + LCG_C, F.lit(LCG_M).cast("long"))


def ranked(points: DataFrame, by: list[str], key: str = "pid") -> DataFrame:
    """points with rank from 0 within the group, by key, and the group's size."""
    return points.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1).withColumn("size", F.count("*").over(Window.partitionBy(*by)))


def hypotheses(points: DataFrame, by: list[str], iterations: int, seed: int = 0) -> DataFrame:
    """by, iter, a, b, c, d of the planes through three drawn points; degenerate draws are left out."""
    sizes = points.groupBy(*by).agg(F.max("size").alias("size")).where("size >= 3")
    draws = sizes.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    state = lcg((F.col("iter") * 3 + seed * 7919 + 1).cast("long"))
    for i in (1, 2, 3):
        draws = draws.withColumn(f"s{i}", lcg(state if i == 1 else F.col(f"s{i - 1}"))).withColumn(f"r{i}", F.pmod(F.floor(F.col(f"s{i}") / 65536), F.col("size")))
    for i in (1, 2, 3):
        at = points.select(*[F.col(c).alias(f"k_{c}") for c in by], F.col("rank").alias("k_rank"), F.struct(*XYZ).alias(f"p{i}"))
        draws = draws.join(at, [*[F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in by], F.col(f"r{i}") == F.col("k_rank")]).drop(*[f"k_{c}" for c in by], "k_rank")
    p, q, r = (vec_of(f"p{i}") for i in (1, 2, 3))
    n = (q - p).cross(r - p)
    length = n.norm()
    ok = draws.withColumn("_len", length).where("_len > 1e-9")
    n = (q - p).cross(r - p).over(F.col("_len"))
    return ok.select(*by, "iter", *[c.alias(k) for c, k in zip(n.parts(), "abc", strict=True)], (-n.dot(p)).alias("d"))


def sampled(points: DataFrame, by: list[str], most: int, seed: int, key: str = "pid") -> DataFrame:
    """At most `most` points of each group, those of the least hash of seed and key, with rank and size as ranked()
    gives them. Spark keeps `most` of a group in each task before it shuffles, so a group may be of any size."""
    window = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key)
    few = points.select(*by, key, *XYZ).withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= most)
    return few.withColumn("rank", F.col("_place") - 1).withColumn("size", F.count("*").over(Window.partitionBy(*by))).drop("_place")


def best_planes(points: DataFrame, by: list[str], threshold: float | Column, iterations: int, seed: int = 0, strict: bool = False, sample: int | None = None) -> DataFrame:
    """by, iter, a, b, c, d, inliers: the hypothesis with most points within the threshold (<=, or < if strict), the
    first in a tie. sample: draw the hypotheses from that many points of each group, chosen by hash; all points count
    as inliers either way."""
    numbered = ranked(points, by) if sample is None else cut_lineage(sampled(points, by, sample, seed))
    h = hypotheses(numbered, by, iterations, seed)
    packed = h.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("iter", "a", "b", "c", "d"))).alias("planes"))  # at most `iterations` entries
    joined = points.join(packed, by)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))

    def near(e: Column) -> Column:
        s = F.abs(e["a"] * F.col("x") + e["b"] * F.col("y") + e["c"] * F.col("z") + e["d"])
        return s < limit if strict else s <= limit

    hits = joined.select(*by, F.explode(F.transform(F.filter("planes", near), lambda e: e["iter"])).alias("iter"))
    counts = hits.groupBy(*by, "iter").agg(F.count("*").alias("inliers"))
    top = counts.groupBy(*by).agg(F.max(F.struct("inliers", (-F.col("iter")).alias("neg"))).alias("m")).select(*by, (-F.col("m.neg")).alias("iter"), F.col("m.inliers").alias("inliers"))
    return h.join(top, [*by, "iter"])


def plane_distance(prefix: str = "") -> Column:
    return F.abs(F.col(f"{prefix}a") * F.col("x") + F.col(f"{prefix}b") * F.col("y") + F.col(f"{prefix}c") * F.col("z") + F.col(f"{prefix}d"))


def with_inliers(points: DataFrame, planes: DataFrame, by: list[str], threshold: float) -> DataFrame:
    return points.join(planes.select(*by, "a", "b", "c", "d"), by).withColumn("inlier", plane_distance() <= threshold)


def refit(points: DataFrame, planes: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Planes fitted to the inliers of the given ones."""
    return fit_planes(with_inliers(points, planes, by, threshold).where("inlier").drop("a", "b", "c", "d"), by)


def accept(clusters: DataFrame, ratio: float = 0.4, least: int = 50) -> DataFrame:
    """Clusters (size, inliers) with a share of inliers over ratio and more than `least` of them."""
    return clusters.where((F.col("inliers") / F.col("size") > ratio) & (F.col("inliers") > least))


def peel(points: DataFrame, by: list[str], k: int, threshold: float, iterations: int, least: int, seed: int = 0) -> DataFrame:
    """Up to k planes a group, one after another on what is left: by, place, a, b, c, d, inliers, rss. Each plane is
    refitted to its inliers, which are then told anew; a group ends with a plane of fewer than `least`."""
    left, out = points, None
    for place in range(k):
        best = best_planes(left, by, threshold, iterations, seed)
        # the fit is written first: a filter on it would be pushed down with copies of its whole expression
        planes = cut_lineage(refit(left, cut_lineage(best), by, threshold).select(*by, "a", "b", "c", "d")).where("a IS NOT NULL")
        told = with_inliers(left, planes, by, threshold).where("inlier")
        sums = told.groupBy(*by).agg(F.count("*").alias("inliers"), F.sum(plane_distance() * plane_distance()).alias("rss")).where(F.col("inliers") >= least)
        found = cut_lineage(planes.join(sums, by).withColumn("place", F.lit(place)))
        out = found if out is None else out.unionByName(found)
        taken = with_inliers(left, found, by, threshold).where("inlier").select("pid")
        left = cut_lineage(left.join(found.select(*by), by, "left_semi").join(taken, "pid", "left_anti"))
    return out


def packs(points: DataFrame, by: list[str], most: int = 20_000) -> DataFrame:
    """by, points: arrays of (pid, x, y, z), some `most` of a group in a row. They are dealt once; rounds then take
    whole rows without a shuffle of points."""
    parts = cut_lineage(points.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")))
    rows = points.join(parts, by).select(*by, F.pmod(F.xxhash64("pid"), F.col("_parts")).alias("_part"), F.struct("pid", *XYZ).alias("_p"))
    return cut_lineage(rows.groupBy(*by, "_part").agg(F.collect_list("_p").alias("points")).drop("_part"))


def best_of_packs(left: DataFrame, sizes: DataFrame, by: list[str], threshold: float, iterations: int, seed: int, sample: int | None) -> DataFrame:
    """As best_planes() with strict, of packs(); sizes: by, left, the groups' sizes. Counts are made by numpy, a plane and a
    pack at a time."""
    rows = left.select(*by, F.explode("points").alias("_p")).select(*by, "_p.*")
    if sample is None:
        numbered = ranked(rows, by)
    else:  # the least hashes are among those under a bound that a group passes some four times over; else all are taken
        bound = F.least(F.lit(1.0), 4.0 * sample / F.col("left")) * 2.0**64 - 2.0**63
        few = rows.join(sizes, by).where(F.xxhash64(F.lit(seed), "pid").cast("double") <= bound)
        numbered = cut_lineage(sampled(few, by, sample, seed))
        short = sizes.join(numbered.groupBy(*by).agg(F.count("*").alias("_few")), by, "left").where(F.coalesce("_few", F.lit(0)) < F.least(F.lit(sample), "left"))
        if not short.isEmpty():
            numbered = cut_lineage(sampled(rows, by, sample, seed))
    h = hypotheses(numbered, by, iterations, seed)
    planes = cut_lineage(h.groupBy(*by).agg(F.collect_list(F.struct("iter", "a", "b", "c", "d")).alias("planes")))  # at most `iterations` entries
    joined = left.join(planes, by).select(*by, F.transform("points", lambda p: F.struct(*[p[a].alias(a) for a in XYZ])).alias("points"), "planes")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, told, inliers = [], [], []
            for row in range(batch.num_rows):
                spots, these = batch.column("points")[row].values, batch.column("planes")[row].values
                x, y, z = (spots.field(a).to_numpy(zero_copy_only=False) for a in XYZ)
                for i, a, b, c, d in zip(*[these.field(k).to_pylist() for k in ("iter", "a", "b", "c", "d")], strict=True):
                    at.append(row)
                    told.append(i)
                    inliers.append(int(np.count_nonzero(np.abs(a * x + b * y + c * z + d) < threshold)))
            groups = batch.select(by).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*groups.columns, pa.array(told, pa.int32()), pa.array(inliers, pa.int64())], names=[*by, "iter", "inliers"])

    kinds = dict(left.dtypes)
    hits = joined.mapInArrow(counted, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", iter int, inliers long")
    counts = hits.groupBy(*by, "iter").agg(F.sum("inliers").alias("inliers")).where("inliers > 0")
    top = counts.groupBy(*by).agg(F.max(F.struct("inliers", (-F.col("iter")).alias("neg"))).alias("m")).select(*by, (-F.col("m.neg")).alias("iter"), F.col("m.inliers").alias("inliers"))
    return planes.select(*by, F.explode("planes").alias("_e")).select(*by, "_e.*").join(top, [*by, "iter"])


def extract_all(points: DataFrame, threshold: float, iterations: int, share: float = 0.02, stop: int = 1000, seed: int = 0, by: list[str] | None = None, sample: int | None = 10_000) -> DataFrame:
    """Planes of a cloud, or of each group of it, however many, until at most `stop` points are left or a plane holds
    under `share` of those left: by, place, a, b, c, d (d <= 0), inliers, left. Each plane takes points away, so the
    rounds end; all groups go through a round together. sample: as of best_planes()."""
    keys = by or ["_g"]
    rows = points.select(*keys, "pid", *XYZ) if by else points.select(F.lit(0).alias("_g"), "pid", *XYZ)
    left = packs(rows, keys)
    found = []
    for place in itertools.count():
        sizes = cut_lineage(left.groupBy(*keys).agg(F.sum(F.size("points")).alias("left")).where(F.col("left") > stop))
        if sizes.isEmpty():
            break
        left = left.join(sizes.select(*keys), keys, "left_semi")
        best = best_of_packs(left, sizes, keys, threshold, iterations, seed + place, sample)
        turn = F.when(F.col("d") > 0, -1.0).otherwise(1.0)
        planes = best.join(sizes, keys).where((F.col("inliers") > 0) & (F.col("inliers") >= share * F.col("left")))
        planes = cut_lineage(planes.select(*keys, F.lit(place).alias("place"), *[(F.col(c) * turn).alias(c) for c in "abcd"], "inliers", "left"))
        if planes.isEmpty():
            break
        found.append(planes)
        off = lambda p: F.abs(F.col("a") * p["x"] + F.col("b") * p["y"] + F.col("c") * p["z"] + F.col("d")) >= threshold
        left = cut_lineage(left.join(planes.select(*keys, *"abcd"), keys).select(*keys, F.filter("points", off).alias("points")))
    if not found:
        kinds = dict(rows.dtypes)
        empty = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "place int", *[f"{c} double" for c in "abcd"], "inliers long", "left long"])
        return points.sparkSession.createDataFrame([], empty).drop("_g")
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.drop("_g")


def sphere_classes(points: DataFrame, radius: float, threshold: float = 0.01, iterations: int = 500, least: int = 200, seed: int = 42) -> DataFrame:
    """sphere_id, x, y, z, n, planes, bic, class for spheres on a grid over the cloud: E below `least` points, else by
    the number of planes of the best of k = 1, 2, 3 (0 E, 1 A, 2 B, 3 C). A further k takes over with more planes and
    a criterion of at most 1.05 times the best, or with a lesser one."""
    from strataspark.operators.spatial import radius_join

    spheres = sphere_grid(points, radius)
    held = cut_lineage(radius_join(spheres.select("sphere_id", "x", "y", "z"), points.select("pid", "x", "y", "z"), radius).select(F.col("sphere_id"), F.concat_ws(":", "sphere_id", "n_pid").alias("pid"), F.col("n_x").alias("x"), F.col("n_y").alias("y"), F.col("n_z").alias("z")))
    sizes = held.groupBy("sphere_id").agg(F.count("*").alias("n"))
    enough = cut_lineage(held.join(sizes.where(F.col("n") >= least), "sphere_id", "left_semi"))
    scored = None
    for k in (1, 2, 3):
        planes = peel(enough, ["sphere_id"], k, threshold, iterations, max(20, least // (k + 1)), seed)
        fit = planes.groupBy("sphere_id").agg(F.count("*").alias("planes"), F.sum("rss").alias("rss"), F.sum("inliers").alias("inliers"))
        noise = (F.col("n") - F.col("inliers")) * threshold * threshold
        one = sizes.join(fit, "sphere_id").select("sphere_id", F.lit(k).alias("k"), "planes", bic(F.col("rss") + noise, F.col("n"), F.col("planes")).alias("bic"))
        scored = one if scored is None else scored.unionByName(one)
    start = F.struct(F.lit(0).cast("long").alias("planes"), F.lit(None).cast("double").alias("bic"))

    def step(a: Column, e: Column) -> Column:
        better = a["bic"].isNull() | ((e["planes"] > a["planes"]) & (e["bic"] <= 1.05 * a["bic"])) | (e["bic"] < a["bic"])
        return F.when(better, F.struct(e["planes"].alias("planes"), e["bic"].alias("bic"))).otherwise(a)

    best = scored.groupBy("sphere_id").agg(F.sort_array(F.collect_list(F.struct("k", "planes", "bic"))).alias("s")).select("sphere_id", F.aggregate("s", start, step).alias("b"))
    kind = F.when((F.col("n") < least) | F.col("planes").isNull() | (F.col("planes") == 0), "E").when(F.col("planes") == 1, "A").when(F.col("planes") == 2, "B").otherwise("C")
    joined = spheres.join(sizes, "sphere_id", "left").join(best.select("sphere_id", "b.planes", "b.bic"), "sphere_id", "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("class", kind)


def sphere_grid(points: DataFrame, radius: float) -> DataFrame:
    """sphere_id, x, y, z: centers radius * sqrt(2) apart over the box less half a radius on every side, y slowest."""
    step = radius * 2**0.5
    box = points.agg(*[(F.min(a) + radius / 2).alias(f"l{a}") for a in XYZ], *[(F.max(a) - radius / 2).alias(f"h{a}") for a in XYZ])
    for a in XYZ:
        box = box.withColumn(f"n{a}", F.greatest(F.lit(1), F.floor((F.col(f"h{a}") - F.col(f"l{a}")) / step) + 1).cast("int"))
    grid = box.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("iz", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
    return grid.select((((F.col("iy") * F.col("nx") + F.col("ix")) * F.col("nz")) + F.col("iz")).cast("long").alias("sphere_id"), *[(F.col(f"l{a}") + F.col(f"i{a}") * step).alias(a) for a in XYZ])


def threshold_from(noise_percent: Column, cm: float = 0.01, default: float = 0.003, least: float = 0.02) -> Column:
    """Detection threshold in metres: three deviations, at least 2 cm."""
    return F.greatest(F.lit(least), 3 * F.coalesce(noise_percent / 100 * cm, F.lit(default)))


