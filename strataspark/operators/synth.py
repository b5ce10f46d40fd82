"""Synthetic planes: patches, bends, waves, control grids, noise; parameter sweeps and their manifests.

Points come from ranges, random numbers from a generator over the row's ids, so that any partitioning gives the same
cloud.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.vec import V3, axis, basis_by_x, rotate, vec


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) for the ids: the upper 53 bits of a mixing hash. Seeds give independent streams."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *[i.cast("long") for i in ids]), 11) / float(1 << 53)


def gaussian(seed: int, *ids: Column) -> Column:
    """A standard normal number for the ids."""
    one, two = uniform(seed, *ids, F.lit(1)), uniform(seed, *ids, F.lit(2))
    return F.sqrt(-2 * F.log(F.greatest(one, F.lit(1e-12)))) * F.cos(2 * math.pi * two)


def bend(u: Column, v: Column, half_u: Column | float, half_v: Column | float, amplitude: Column | float) -> Column:
    a, b = u / half_u, v / half_v
    return amplitude * (a * a + b * b)


def wave(u: Column, v: Column, half_u: Column | float, amplitude: Column | float, waves: float = 2.0) -> Column:
    return amplitude * F.sin(math.pi * waves * (u + half_u) / half_u)


def patches(specs: DataFrame, seed: int = 42, clamp: float | None = None) -> DataFrame:
    """patch, pid, x, y, z: plane patches with their disturbances along the normal, one for each row of (patch, cx, cy,
    cz, nx, ny, nz, half_u, half_v, step, sigma, bend_m, wave_m, grid_k, grid_m). A patch's points are those of its grid,
    both ends included; clamp: into a cube from the origin."""
    length = vec("nx", "ny", "nz").norm()
    size = lambda half: (F.round(2 * F.col(half) / F.col("step")) + 1).cast("long")
    rows = specs.select("*", *[(F.col(f"n{k}") / length).alias(f"_n{k}") for k in "xyz"], size("half_u").alias("_nu"), size("half_v").alias("_nv"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nu") * F.col("_nv") - 1)).alias("pid"))
    iu, iv = F.floor(F.col("pid") / F.col("_nv")), F.pmod(F.col("pid"), F.col("_nv"))
    rows = rows.withColumn("u", -F.col("half_u") + iu * F.col("step")).withColumn("v", -F.col("half_v") + iv * F.col("step"))
    k = F.greatest(F.col("grid_k"), F.lit(1))
    p, q = (F.col("u") + F.col("half_u")) / (2 * F.col("half_u")) * k, (F.col("v") + F.col("half_v")) / (2 * F.col("half_v")) * k
    rows = rows.withColumn("_i", F.least(F.floor(p), k - 1).cast("long")).withColumn("_j", F.least(F.floor(q), k - 1).cast("long"))
    rows = rows.withColumn("_s", p - F.col("_i")).withColumn("_t", q - F.col("_j"))
    at = lambda di, dj: (2 * uniform(seed, F.col("patch"), F.col("_i") + di, F.col("_j") + dj) - 1) * F.col("grid_m")  # noqa: E731  control heights are a function of their place
    s, t = F.col("_s"), F.col("_t")
    h = F.when(F.col("grid_k") >= 1, at(0, 0) * (1 - s) * (1 - t) + at(1, 0) * s * (1 - t) + at(0, 1) * (1 - s) * t + at(1, 1) * s * t).otherwise(0.0)
    off = h + bend(F.col("u"), F.col("v"), F.col("half_u"), F.col("half_v"), F.col("bend_m")) + wave(F.col("u"), F.col("v"), F.col("half_u"), F.col("wave_m")) + F.col("sigma") * gaussian(seed + 1, F.col("patch"), F.col("pid"))
    rows = rows.withColumn("_off", off)
    n = vec("_nx", "_ny", "_nz")
    e, f = basis_by_x(n)
    x = vec("cx", "cy", "cz") + e * F.col("u") + f * F.col("v") + n * F.col("_off")
    if clamp is not None:
        x = V3(*[F.greatest(F.lit(0.0), F.least(F.lit(clamp), c)) for c in x.parts()])
    return rows.select("patch", "pid", *[c.alias(a) for c, a in zip(x.parts(), "xyz", strict=True)])


def patch(spark: SparkSession, center: tuple, normal: tuple, half_u: float, half_v: float, step: float, sigma: float = 0.0, bend_m: float = 0.0, wave_m: float = 0.0, grid_k: int = 0, grid_m: float = 0.0, seed: int = 42, clamp: float | None = None) -> DataFrame:
    """pid, x, y, z of one patch, with the parameters of patches()."""
    named = {"cx": center[0], "cy": center[1], "cz": center[2], "nx": normal[0], "ny": normal[1], "nz": normal[2], "half_u": half_u, "half_v": half_v, "step": step, "sigma": sigma, "bend_m": bend_m, "wave_m": wave_m, "grid_m": grid_m}
    spec = spark.range(1).select(F.lit(0).cast("long").alias("patch"), *[F.lit(float(v)).alias(k) for k, v in named.items()], F.lit(grid_k).alias("grid_k"))
    return patches(spec, seed, clamp).drop("patch")


def plane_of_patch(center: tuple, normal: tuple) -> tuple[float, float, float, float]:
    length = math.sqrt(sum(c * c for c in normal))
    a, b, c = (k / length for k in normal)
    return a, b, c, -(a * center[0] + b * center[1] + c * center[2])


def book(spark: SparkSession, degrees: float, width: float, area_a: float, area_b: float, step: float, sigma: float = 0.0, seed: int = 123) -> DataFrame:
    """part, pid, x, y, z: two patches that share the edge x = z = 0, at the angle; part A keeps what is on B's side of
    the edge and the other way round."""
    t = math.radians(degrees)
    one, two = (0.0, 0.0, 1.0), (math.sin(t), 0.0, -math.cos(t))
    a = patch(spark, (width * area_a / 2, 0, 0), one, width / 2, width * area_a / 2, step, sigma, seed=seed)
    b = patch(spark, (math.cos(t) * width * area_b / 2, 0, math.sin(t) * width * area_b / 2), two, width / 2, width * area_b / 2, step, sigma, seed=seed + 1)
    edge_a, edge_b = (1.0, 0.0, 0.0), (math.cos(t), 0.0, math.sin(t))
    side = lambda d, e: d.where(vec("x", "y", "z").dot(vec(*e)) >= -1e-9)
    return side(a, edge_a).withColumn("part", F.lit("A")).unionByName(side(b, edge_b).withColumn("part", F.lit("B"))).select("part", "pid", "x", "y", "z")


def pyramid_height(degrees: float, base: float) -> float:
    """Height over an equilateral base at which the three side faces meet pairwise at the angle. The sides' unit
    normals have a vertical part z with n.n' = (3 z^2 - 1) / 2, and the angle between the faces is pi less theirs."""
    z2 = (1 - 2 * math.cos(math.radians(degrees))) / 3
    inradius = base / (2 * math.sqrt(3))
    if not 0 < z2 < 1:
        raise ValueError("no pyramid has faces at this angle")
    return inradius * math.sqrt((1 - z2) / z2)


def pyramid(spark: SparkSession, degrees: float, base: float, step: float, sigma: float = 0.0, seed: int = 7) -> DataFrame:
    """face, pid, x, y, z: points of the three side faces over an equilateral base around the origin."""
    h = pyramid_height(degrees, base)
    r = base / math.sqrt(3)
    n = int(round(base / step)) + 1
    ids = spark.range(3 * n * n).select("id", (F.col("id") / (n * n)).cast("int").alias("face"), ((F.col("id") / n).cast("long") % n / (n - 1)).alias("s"), (F.col("id") % n / (n - 1)).alias("t")).where("s + t <= 1")
    corner = lambda k: (r * F.cos(2 * math.pi / 3 * k), r * F.sin(2 * math.pi / 3 * k))
    (ax, ay), (bx, by) = corner(F.col("face")), corner(F.col("face") + 1)
    s, t = F.col("s"), F.col("t")
    flat = V3(ax * s + bx * t, ay * s + by * t, h * (1 - s - t))
    turn = math.pi / 3 * 1.0
    outward = vec(F.cos(2 * math.pi / 3 * F.col("face") + turn) * h, F.sin(2 * math.pi / 3 * F.col("face") + turn) * h, base / (2 * math.sqrt(3)))
    p = flat + outward / outward.norm() * (sigma * gaussian(seed, F.col("id")))
    return ids.select("face", F.col("id").alias("pid"), *[c.alias(a) for c, a in zip(p.parts(), "xyz", strict=True)])


#: Shares of points of up to three faces of a cube's corner, a case each. Fixed values.
CORNER_CASES = ((100,), (10, 90), (20, 80), (30, 70), (40, 60), (50, 50), (30, 35, 35), (40, 30, 30), (50, 25, 25), (60, 20, 20), (70, 15, 15), (80, 10, 10), (90, 5, 5))


def corners_of(rows: DataFrame, size: float = 10.0, sigma: float = 0.02, outliers: float = 0.02, degrees: float = 5.0, seed: int = 123) -> DataFrame:
    """case, pid, plane (null for outliers), x, y, z: a point for each row of (case, pid), of the corner whose shares
    CORNER_CASES gives for the case: noise along the face's normal, uniform outliers, each face turned by up to `degrees`
    around the cube's middle (by angles of the case and face), all clamped to the cube."""
    case, i = F.col("case"), F.col("pid")
    rnd = lambda k: uniform(seed + k, case, i)
    limits = F.array(*[F.array(*[F.lit(sum(c[: k + 1]) / sum(c)) for k in range(len(c))]) for c in CORNER_CASES])
    own = F.get(limits, case.cast("int"))
    drawn = rows.select("case", "pid", own.alias("_limits"), rnd(1).alias("_r"), (rnd(6) < outliers).alias("_out"))
    # the first face whose limit is over the draw
    drawn = drawn.withColumn("plane", F.when(~F.col("_out"), F.least(F.size(F.filter("_limits", lambda x: x <= F.col("_r"))), F.size("_limits") - 1)))
    drawn = drawn.select("case", "pid", "plane", (size * rnd(2)).alias("s"), (size * rnd(3)).alias("t"), (sigma * gaussian(seed + 4, case, i)).alias("e"), (size * rnd(5)).alias("w"))
    k = F.col("plane")
    x = F.when(k == 1, F.col("e")).otherwise(F.col("s"))
    y = F.when(k == 2, F.col("e")).when(k == 1, F.col("s")).otherwise(F.col("t"))
    z = F.when(k == 0, F.col("e")).when(k.isNull(), F.col("w")).otherwise(F.col("t"))
    tilt = lambda n: F.radians((2 * uniform(seed + n, case, F.coalesce(k, F.lit(-1))) - 1) * degrees)
    placed = drawn.select("case", "pid", "plane", x.alias("x"), y.alias("y"), z.alias("z"), F.when(k.isNull(), 0.0).otherwise(tilt(7)).alias("_a"), F.when(k.isNull(), 0.0).otherwise(tilt(8)).alias("_b"))
    mid = vec(size / 2, size / 2, size / 2)
    turned = rotate(rotate(vec("x", "y", "z") - mid, axis(0), F.degrees("_a")), axis(1), F.degrees("_b")) + mid
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(size), c))
    return placed.select("case", "pid", "plane", *[clamp(c).alias(a) for c, a in zip(turned.parts(), "xyz", strict=True)])


def icosahedron_of(rows: DataFrame, sigma: float = 0.02, seed: int = 1) -> DataFrame:
    """pid, face, x, y, z: a point of the 20 faces of a unit icosahedron for each row of (pid), uniform over them, with
    noise along the normals."""
    import numpy as np

    from strataspark.functions.hull import hull3

    g = (1 + math.sqrt(5)) / 2
    v = np.array([p for a in (-1, 1) for b in (-g, g) for p in ((0, a, b), (a, b, 0), (b, 0, a))]) / math.sqrt(1 + g * g)
    faces = v[hull3(v)].reshape(20, 9).tolist()
    table = F.array(*[F.array(*map(F.lit, f)) for f in faces])
    i = F.col("pid")
    drawn = rows.select("pid", F.least(F.floor(uniform(seed, i) * 20), F.lit(19)).cast("int").alias("face"), F.sqrt(uniform(seed + 1, i)).alias("s"), uniform(seed + 2, i).alias("t")).withColumn("f", F.get(table, F.col("face")))
    at = lambda k: vec(*[F.col("f")[3 * k + c] for c in range(3)])
    s, t = F.col("s"), F.col("t")
    p = at(0) * (1 - s) + at(1) * (s * (1 - t)) + at(2) * (s * t)
    m = at(0) + at(1) + at(2)
    p = p + m / m.norm() * (sigma * gaussian(seed + 3, i))
    return drawn.select("pid", "face", *[c.alias(a) for c, a in zip(p.parts(), "xyz", strict=True)])


def sweep(spark: SparkSession, **parameters: list) -> DataFrame:
    """Every combination of the parameters' values, with an index in the order of the parameters."""
    names = list(parameters)
    total = math.prod(len(v) for v in parameters.values())
    rows, rest = [F.col("id").alias("index")], F.col("id")
    for name in reversed(names):
        values = parameters[name]
        rows.insert(1, F.element_at(F.array(*map(F.lit, values)), (rest % len(values) + 1).cast("int")).alias(name))
        rest = F.floor(rest / len(values))
    return spark.range(total).select(*rows)


def manifest_names(runs: DataFrame, kind: str = "Plane1") -> DataFrame:
    """runs (angle, area, sigma_mm, bend, grid, wave) with file names; numbers are rounded half to even."""
    whole = lambda c: F.bround(F.col(c).cast("double"), 0).cast("int").cast("string")
    name = F.concat(F.lit(f"{kind}_Ang"), whole("angle"), F.lit("_Ara"), whole("area"), F.lit("%_Gno"), whole("sigma_mm"), F.lit("mm_Ben"), whole("bend"), F.lit("_Grid"), whole("grid"), F.lit("_Sin"), whole("wave"), F.lit(".ply"))
    return runs.withColumn("filename", name)


def resume(runs: DataFrame, done: DataFrame, on: str = "filename") -> DataFrame:
    """Runs that have no output yet."""
    return runs.join(done.select(on), on, "left_anti")
