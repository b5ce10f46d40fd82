"""Queries over scalar vector functions and filters, with the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import vec as V
from strataspark.functions.vec import vec, vec_of
from strataspark.operators import analysis
from strataspark.plans.clouds import cloud, sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(c: Column, name: str, places: int = 6) -> Column:
    return (F.round(c, places) + 0.0).alias(name)


def _rr(**named: str) -> str:
    return ", ".join(f"round({e}, {4 if k.startswith('deg') else 6}) + 0.0 AS {k}" for k, e in named.items())


_UNIT = "u AS (SELECT *, sqrt(a * a + b * b + c * c) AS n, a / sqrt(a * a + b * b + c * c) AS ux, b / sqrt(a * a + b * b + c * c) AS uy, c / sqrt(a * a + b * b + c * c) AS uz FROM planes)"


@query(
    sql("planes") + f", {_UNIT}, o AS (SELECT *, CASE WHEN uz < 0 THEN -1 ELSE 1 END AS s, CASE WHEN ux * (5 - d) + uy * (2 - d) + uz * (1 - d) < 0 THEN -1 ELSE 1 END AS w FROM u) SELECT pid, "
    + _rr(unit_x="ux", unit_y="uy", length="n", up_x="ux * s", up_z="uz * s", view_x="ux * w", view_z="uz * w", deg_to_z="degrees(acos(greatest(-1, least(1, uz))))", deg_dip="degrees(acos(least(1, abs(uz))))",
          deg_strike="CASE WHEN degrees(atan2(-uy, ux)) < 0 THEN degrees(atan2(-uy, ux)) + 360 ELSE degrees(atan2(-uy, ux)) END", deg_comp="90 - degrees(acos(least(1, abs(uz))))", deg_azimuth="CASE WHEN degrees(atan2(ux, uy)) < 0 THEN degrees(atan2(ux, uy)) + 360 ELSE degrees(atan2(ux, uy)) END",
          deg_dipdir="CASE WHEN degrees(atan2(ux * s, uy * s)) < 0 THEN degrees(atan2(ux * s, uy * s)) + 360 ELSE degrees(atan2(ux * s, uy * s)) END", deg_pole_dir="CASE WHEN uy <> 0 THEN 180 + degrees(atan(ux / uy)) END", pole_dip="90 * sqrt(ux * ux + uy * uy)", chord="2 * sin(radians(abs(d)) / 2)") + " FROM o"
)
def v_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalising, angles, chords, turning to +z and to a viewpoint, dip and strike in all conventions."""
    p = cloud(spark, sf_dir, "planes")
    n, d = vec("a", "b", "c"), F.col("d")
    u = V.unit(n)
    up, view = V.orient(u, V.axis(2)), V.orient_to_viewpoint(u, vec(d, d, d), vec(5, 2, 1))
    comp, azimuth = V.orientation(u, "complement")
    pole_dip, pole_dir = V.pole(u.x, u.y)
    return p.select("pid", r(u.x, "unit_x"), r(u.y, "unit_y"), r(V.safe_unit(n)[1], "length"), r(up.x, "up_x"), r(up.z, "up_z"), r(view.x, "view_x"), r(view.z, "view_z"), r(F.degrees(V.angle(u, V.axis(2))), "deg_to_z", 4), r(V.dip(u), "deg_dip", 4), r(V.strike(u), "deg_strike", 4), r(comp, "deg_comp", 4), r(azimuth, "deg_azimuth", 4), r(V.dip_direction(u), "deg_dipdir", 4), r(pole_dir, "deg_pole_dir", 4), r(pole_dip, "pole_dip"), r(V.chord(F.abs(d)), "chord"))


@query(
    sql("planes") + f", {_UNIT}, z AS (SELECT *, sqrt(uy * uy + ux * ux) AS k FROM u), b AS (SELECT *, CASE WHEN k > 1e-6 THEN uy / k ELSE 0 END AS zx, CASE WHEN k > 1e-6 THEN -ux / k ELSE uz END AS zy, CASE WHEN k > 1e-6 THEN 0 ELSE -uy END AS zz FROM z),"
    " h AS (SELECT *, CASE WHEN abs(ux) >= 0.9 THEN -uz ELSE 0 END AS hx, CASE WHEN abs(ux) >= 0.9 THEN 0 ELSE uz END AS hy, CASE WHEN abs(ux) >= 0.9 THEN ux ELSE -uy END AS hz FROM b),"
    " g AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS hn FROM h) SELECT pid, "
    + _rr(zx="zx", zy="zy", zz="zz", wz="ux * zy - uy * zx", hx="hx / hn", hy="hy / hn", hz="hz / hn", s="1 * zx + 2 * zy + 3 * zz", t="1 * (uy * zz - uz * zy) + 2 * (uz * zx - ux * zz) + 3 * (ux * zy - uy * zx)") + " FROM g"
)
def v_plane_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-plane bases by either helper, and projection to and from the plane."""
    u = V.unit(vec("a", "b", "c"))
    e, f = V.basis_by_z(u)
    h, _ = V.basis_by_x(u)
    p = cloud(spark, sf_dir, "planes")
    origin = vec(0, 0, 0)
    s, t = V.to_plane(vec(1, 2, 3), origin, e, f)
    return p.select("pid", r(e.x, "zx"), r(e.y, "zy"), r(e.z, "zz"), r(f.z, "wz"), r(h.x, "hx"), r(h.y, "hy"), r(h.z, "hz"), r(s, "s"), r(t, "t"))


@query(
    sql("planes") + f", {_UNIT} SELECT pid, " + _rr(distance="(a * 1 + b * 2 + c * 3 + d) / n", nd="d / n", na="a / n") + ", (a + 2 * b + 3 * c + d) / n < 0 AND (a + 2 * b + 3 * c + d) / n > -3 AS in_slab FROM u"
)
def v_plane_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distances, normalised planes, the slab predicate."""
    n, d, p = vec("a", "b", "c"), F.col("d"), vec(1, 2, 3)
    m, e = V.normal_plane(n, d)
    return cloud(spark, sf_dir, "planes").select("pid", r(V.signed_distance(p, n, d), "distance"), r(e, "nd"), r(m.x, "na"), V.in_slab(p, n, d, 3).alias("in_slab"))


_DET = "(a1 * (b2 * c3 - c2 * b3) - b1 * (a2 * c3 - c2 * a3) + c1 * (a2 * b3 - b2 * a3))"


@query(
    sql("planes") + ", t AS (SELECT p.pid, p.a a1, p.b b1, p.c c1, p.d d1, q.a a2, q.b b2, q.c c2, q.d d2, s.a a3, s.b b3, s.c c3, s.d d3 FROM planes p JOIN planes q ON q.pid = p.pid + 1 JOIN planes s ON s.pid = p.pid + 2),"
    f" m AS (SELECT *, {_DET} AS det FROM t) SELECT pid, "
    + _rr(x=f"-(d1 * (b2 * c3 - c2 * b3) + d2 * (b3 * c1 - c3 * b1) + d3 * (b1 * c2 - c1 * b2)) / det", y="-(d1 * (c2 * a3 - a2 * c3) + d2 * (c3 * a1 - a3 * c1) + d3 * (c1 * a2 - a1 * c2)) / det", z="-(d1 * (a2 * b3 - b2 * a3) + d2 * (a3 * b1 - b3 * a1) + d3 * (a1 * b2 - b1 * a2)) / det")
    + " FROM m WHERE abs(det) >= 1e-3"
)
def v_three_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of three planes, where they are not near to parallel."""
    p = cloud(spark, sf_dir, "planes")
    side = lambda k: p.select((F.col("pid") - k + 1).alias("pid"), *[F.col(c).alias(f"{c}{k}") for c in "abcd"])
    x = V.three_planes(*[e for k in (1, 2, 3) for e in (vec(f"a{k}", f"b{k}", f"c{k}"), F.col(f"d{k}"))], eps=1e-3)
    return side(1).join(side(2), "pid").join(side(3), "pid").select("pid", *[r(c, a) for c, a in zip(x.parts(), "xyz", strict=True)]).where("x IS NOT NULL")


@query(
    sql("planes") + ", t AS (SELECT p.pid, p.a a1, p.b b1, p.c c1, p.d d1, q.a a2, q.b b2, q.c c2, q.d d2 FROM planes p JOIN planes q ON q.pid = p.pid + 1), l AS (SELECT *, b1 * c2 - c1 * b2 AS lx, c1 * a2 - a1 * c2 AS ly, a1 * b2 - b1 * a2 AS lz FROM t), k AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS ln FROM l) SELECT pid, "
    + _rr(dx="lx / ln", dy="ly / ln", dz="lz / ln", gap1="0.0", gap2="0.0", foot="0.0") + " FROM k WHERE ln >= 1e-3"
)
def v_two_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of two planes: its direction, and that its point is on both planes and nearest to the origin."""
    p = cloud(spark, sf_dir, "planes")
    side = lambda k: p.select((F.col("pid") - k + 1).alias("pid"), *[F.col(c).alias(f"{c}{k}") for c in "abcd"])
    j = side(1).join(side(2), "pid")
    n = {k: vec(f"a{k}", f"b{k}", f"c{k}") for k in (1, 2)}
    on = {k: n[k] * (-F.col(f"d{k}") / n[k].dot(n[k])) for k in (1, 2)}
    direction, point = V.two_planes(n[1], on[1], n[2], on[2], 1e-3)
    rows = j.select("pid", direction.struct().alias("l"), point.struct().alias("p"), *[c for k in (1, 2) for c in (f"a{k}", f"b{k}", f"c{k}", f"d{k}")]).where("l.x IS NOT NULL")
    gap = lambda k: n[k].dot(vec_of("p")) + F.col(f"d{k}")
    return rows.select("pid", r(F.col("l.x"), "dx"), r(F.col("l.y"), "dy"), r(F.col("l.z"), "dz"), r(gap(1), "gap1"), r(gap(2), "gap2"), r(vec_of("l").dot(vec_of("p")), "foot"))


@query(
    sql("parts") + ", t AS (SELECT *, x - 25 AS px, y - 12 AS py FROM parts) SELECT pid, "
    + _rr(rot_x="px * cos(radians(30)) - py * sin(radians(30))", rot_y="px * sin(radians(30)) + py * cos(radians(30))", radius="CASE WHEN abs(px * py) > 1e-9 THEN sqrt(px * px + py * py) / 2 END", volume="abs(px * py * z) / 6")
    + ", x >= 10 AND x < 20 AND y >= 9 AND y < 15 AND z >= 2 AND z < 9 AS in_box, x >= 0 AND y >= 0 AND x / 60 + y / 30 <= 1 + 1e-9 AS in_triangle FROM t"
)
def v_rotate_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation, circumradius, tetrahedron volume, point in box and in triangle."""
    p = cloud(spark, sf_dir, "parts").withColumn("px", F.col("x") - 25).withColumn("py", F.col("y") - 12)
    turned = V.rotate(vec("px", "py", 0), V.axis(2), 30)
    o, ex, ey = vec(0, 0, 0), vec("px", 0, 0), vec(0, "py", 0)
    radius = F.when(F.abs(F.col("px") * F.col("py")) > 1e-9, V.circumradius(o, ex, ey))
    return p.select("pid", r(turned.x, "rot_x"), r(turned.y, "rot_y"), r(radius, "radius"), r(V.tetra_volume(o, ex, ey, vec(0, 0, "z")), "volume"), V.in_box(vec("x", "y", "z"), vec(10, 9, 2), vec(20, 15, 9)).alias("in_box"), V.in_triangle(F.col("x"), F.col("y"), (0, 0), (60, 0), (0, 30)).alias("in_triangle"))


@query(
    sql("disks") + ", s AS (SELECT pid, x AS x1, y AS y1, x + a * 20 AS x2, y + b * 20 AS y2 FROM disks), t AS (SELECT p.pid, p.x1, p.y1, p.x2, p.y2, q.x1 AS u1, q.y1 AS v1, q.x2 AS u2, q.y2 AS v2 FROM s p JOIN s q ON q.pid = p.pid + 1),"
    " d AS (SELECT *, (x2 - x1) * (v2 - v1) - (y2 - y1) * (u2 - u1) AS det FROM t) SELECT pid, least(x1, x2) <= greatest(u1, u2) AND least(u1, u2) <= greatest(x1, x2) AND least(y1, y2) <= greatest(v1, v2) AND least(v1, v2) <= greatest(y1, y2) AS boxes,"
    " coalesce(abs(det) > 1e-12 AND ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / det BETWEEN -0.001 AND 1.001 AND ((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1)) / det BETWEEN -0.001 AND 1.001, false) AS hit FROM d"
)
def v_segments_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that cross in XY, and their boxes."""
    s = cloud(spark, sf_dir, "disks").select("pid", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("a") * 20).alias("x2"), (F.col("y") + F.col("b") * 20).alias("y2"))
    t = s.select((F.col("pid") - 1).alias("pid"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"))
    p, q, a, b = vec("x1", "y1", 0), vec("x2", "y2", 0), vec("u1", "v1", 0), vec("u2", "v2", 0)
    return s.join(t, "pid").select("pid", V.boxes_meet_xy(p, q, a, b).alias("boxes"), V.cross_xy(p, q, a, b).alias("hit"))


@query(
    sql("disks") + ", t AS (SELECT pid, ra * 100 AS ra, x * 8 - 400 AS h FROM disks) SELECT pid, " + "round(CASE WHEN abs(h) <= ra THEN sqrt(ra * ra - h * h) END, 4) + 0.0 AS x1, round(CASE WHEN abs(h) <= ra THEN h END, 4) + 0.0 AS z1, CASE WHEN abs(h) <= ra THEN 0.0 END AS \"both\"" + " FROM t"
)
def v_circle_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points at which a circle in the XZ plane meets the planes z = h."""
    h = F.col("x") * 8 - 400
    p, q = V.circle_plane(vec(0, 0, 0), V.axis(2), V.axis(0), F.col("ra") * 100, V.axis(2), -h)
    return cloud(spark, sf_dir, "disks").select("pid", r(F.greatest(p.x, q.x), "x1", 4), r(p.z, "z1", 4), r(p.x + q.x, "both"))


@query(
    sql("parts") + " SELECT pid, greatest(x * 3 - 2 * y, y - 9, -z) <= 40 AS feasible, greatest(x - 30, 5 - x, y - 14, z - 12) <= 1e-9 AS in_hull FROM parts"
)
def v_half_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points behind all of several planes, by an array of planes."""
    plane = lambda a, b, c, d: F.struct(*[F.lit(float(v)).alias(k) for v, k in zip((a, b, c, d), "abcd", strict=True)])
    one = F.array(plane(3, -2, 0, -40), plane(0, 1, 0, -49), plane(0, 0, -1, -40))
    two = F.array(plane(1, 0, 0, -30), plane(-1, 0, 0, 5), plane(0, 1, 0, -14), plane(0, 0, 1, -12))
    p = vec("x", "y", "z")
    return cloud(spark, sf_dir, "parts").select("pid", V.inside_hull(p, one).alias("feasible"), V.inside_hull(p, two).alias("in_hull"))


@query(
    sql("parts") + ", t AS (SELECT pid, x AS w, y AS h, pid % 5 AS k FROM parts) SELECT pid, " + _rr(area="w * h", signed="w * h", nx="0.0", nz="2 * w * h", cx="w / 2", cy="h / 2")
    + ", k = 0 AS coplanar, CASE WHEN pid % 3 = 0 THEN '1,2,4,3' WHEN pid % 3 = 1 THEN '1,3,2,4' ELSE '1,2,3,4' END AS ring FROM t"
)
def v_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newell normal, areas, centroid, coplanarity and the normal form of a ring."""
    p = cloud(spark, sf_dir, "parts")
    w, h = F.col("x"), F.col("y")
    corner = lambda x, y, z: F.struct(V.col(x).alias("x"), V.col(y).alias("y"), V.col(z).alias("z"))
    flat = F.array(corner(0, 0, 0), corner(w, 0, 0), corner(w, h, 0), corner(0, h, 0))
    bent = F.array(corner(0, 0, 0), corner(w, 0, 0), corner(w, h, 0), corner(0, h, (F.col("pid") % 5).cast("double")))
    ring = F.when(F.col("pid") % 3 == 0, F.array(*map(F.lit, (4, 3, 1, 2)))).when(F.col("pid") % 3 == 1, F.array(*map(F.lit, (4, 2, 3, 1)))).otherwise(F.array(*map(F.lit, (3, 2, 1, 4))))
    rows = p.select("pid", flat.alias("flat"), bent.alias("bent"), ring.alias("ids"))
    n, c = V.newell(F.col("flat")), V.mean_point(F.col("flat"))
    return rows.select("pid", r(V.fan_area(F.col("flat")), "area"), r(V.shoelace(F.col("flat")), "signed"), r(n.x, "nx"), r(n.z, "nz"), r(c.x, "cx"), r(c.y, "cy"), V.coplanar(F.col("bent")).alias("coplanar"), F.array_join(V.ring(F.col("ids")).cast("array<string>"), ",").alias("ring"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %dmin %.2fs', h, m, q) WHEN s >= 60 THEN printf('%dmin %.2fs', m, q) ELSE printf('%.2fs', q) END AS told FROM (SELECT event_id, s, (floor(s / 3600))::BIGINT AS h, (floor((s - 3600 * floor(s / 3600)) / 60))::BIGINT AS m, (s - 60 * floor(s / 60))::DOUBLE AS q FROM (SELECT event_id, (event_id * 37 % 9000)::DOUBLE AS s FROM events))")
def v_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations as text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", V.duration((F.col("event_id") * 37 % 9000).cast("double")).alias("told"))


# Filters


@query(
    sql("pts") + ", g AS (SELECT grp, count(*) AS n, count(DISTINCT (x, y, z)) AS m FROM pts GROUP BY grp), s AS (SELECT quantile_cont(y, 0.9) AS q, avg(y) - 1.5 * stddev_pop(y) AS lo FROM pts) SELECT p.grp, count(*)::BIGINT AS kept, "
    "sum(CASE WHEN y >= q THEN 1 ELSE 0 END)::BIGINT AS top, sum(CASE WHEN y >= lo THEN 1 ELSE 0 END)::BIGINT AS above, sum(CASE WHEN x >= 10 AND x < 30 AND y >= 5 AND y < 40 AND z >= 0 AND z < 5 THEN 1 ELSE 0 END)::BIGINT AS boxed, "
    + "round(sum(greatest(0, least(20, x))), 4) + 0.0 AS clamped FROM pts p JOIN g ON g.grp = p.grp AND g.n >= 50 AND g.m > 1 CROSS JOIN s GROUP BY p.grp"
)
def f_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of enough and of distinct points, score cuts by quantile and by deviations, box crop, clamp."""
    p = cloud(spark, sf_dir, "pts")
    groups = p.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("x", "y", "z").alias("m")).where("n >= 50 AND m > 1")
    kept = p.join(groups.select("grp"), "grp", "left_semi")
    cut = lambda name, **how: analysis.score_cut(p, "y", **how).groupBy("grp").agg(F.count("*").alias(name))
    boxed = V.in_box(vec("x", "y", "z"), vec(10, 5, 0), vec(30, 40, 5))
    n = lambda c, k: F.sum(c.cast("long")).alias(k)
    sums = kept.groupBy("grp").agg(F.count("*").alias("kept"), n(boxed, "boxed"), r(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(20.0), F.col("x")))), "clamped", 4))
    return sums.join(cut("top", quantile=0.9), "grp", "left").join(cut("above", k=1.5), "grp", "left").fillna(0, ["top", "above"])


# Robustness tables

_RUNS = ", r AS (SELECT file, ratio, try_cast(regexp_extract(file, '(?i)gno(\\d+)', 1) AS INTEGER) AS gno, try_cast(regexp_extract(file, '(?i)grid(\\d+)', 1) AS INTEGER) AS grid, try_cast(regexp_extract(file, '(?i)sin(\\d+)', 1) AS INTEGER) AS sin, try_cast(regexp_extract(file, '(?i)ben(\\d+)', 1) AS INTEGER) AS ben, event_id FROM runs)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir, "runs").select("event_id", "file", "ratio", *analysis.name_params(F.col("file")))


@query(sql("runs") + _RUNS + " SELECT event_id, gno, grid, sin, ben, round(greatest(0.02, 3 * coalesce(gno / 100.0 * 0.01, 0.003)), 6) + 0.0 AS threshold FROM r")
def a_name_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in file names, and the detection threshold that follows."""
    from strataspark.operators.ransac import threshold_from

    return _runs(spark, sf_dir).select("event_id", "gno", "grid", "sin", "ben", r(threshold_from(F.col("gno")), "threshold"))


@query(
    sql("runs") + _RUNS + ", m AS (SELECT file, max(event_id % 7)::BIGINT AS gno2, (max(event_id) % 11)::BIGINT AS sin2 FROM r WHERE event_id % 3 <> 0 GROUP BY file) SELECT r.event_id, coalesce(r.gno, m.gno2)::BIGINT AS gno, coalesce(r.sin, m.sin2)::BIGINT AS sin FROM r LEFT JOIN m ON m.file = r.file WHERE coalesce(r.sin, m.sin2) IS NOT NULL"
)
def a_merge_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined with a manifest that fills what their names lack; rows without a key go."""
    runs = _runs(spark, sf_dir).select("event_id", "file", F.col("gno").cast("long").alias("gno"), F.col("sin").cast("long").alias("sin"))
    manifest = runs.where("event_id % 3 <> 0").groupBy("file").agg(F.max(F.col("event_id") % 7).alias("gno"), (F.max("event_id") % 11).alias("sin"))
    return analysis.merge_missing(runs, manifest, "file", ["gno", "sin"]).dropna(subset=["sin"]).select("event_id", "gno", "sin")


@query(sql("runs") + _RUNS + " SELECT gno, round(avg(ratio), 6) + 0.0 AS mean, round(stddev_samp(ratio), 6) + 0.0 AS std, count(ratio)::BIGINT AS n FROM r GROUP BY gno")
def a_mean_by_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.mean_std(_runs(spark, sf_dir), "gno", "ratio").select("gno", r(F.col("mean"), "mean"), r(F.col("std"), "std"), "n")


@query(sql("runs") + _RUNS + " SELECT grid, sin, round(avg(ratio), 6) + 0.0 AS mean, count(ratio)::BIGINT AS n FROM r WHERE sin IS NOT NULL GROUP BY grid, sin")
def a_mean_by_grid_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.mean_by(_runs(spark, sf_dir).where("sin IS NOT NULL"), ["grid", "sin"], "ratio").select("grid", "sin", r(F.col("mean"), "mean"), "n")


@query(sql("runs") + _RUNS + " SELECT sin, " + ", ".join(f"round(avg(ratio) FILTER (WHERE grid = {g}), 6) + 0.0 AS g{g}" for g in (0, 2, 4, 6, 8, 10)) + " FROM r WHERE sin IS NOT NULL GROUP BY sin")
def a_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [0, 2, 4, 6, 8, 10]
    wide = analysis.heat_map(_runs(spark, sf_dir).where("sin IS NOT NULL"), "sin", "grid", "ratio", known)
    return wide.select("sin", *[r(F.col(str(g)), f"g{g}") for g in known])


@query(
    sql("runs") + _RUNS + ", q AS (SELECT unnest([0, 1, 2]) AS band, unnest([quantile_cont(gno, 0.25), quantile_cont(gno, 0.5), quantile_cont(gno, 0.75)]) AS v FROM r) SELECT band, trunc(v)::INTEGER AS q, ben, round(avg(ratio), 6) + 0.0 AS mean, count(ratio)::BIGINT AS n FROM r JOIN q ON r.gno BETWEEN trunc(v) - 10 AND trunc(v) + 10 GROUP BY ALL"
)
def a_quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.quantile_bands(_runs(spark, sf_dir), "gno", "ben", "ratio").select("band", "q", "ben", r(F.col("mean"), "mean"), "n")


# Sinks' tables


@query(
    "WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN lpad(upper(to_hex(event_id % 16777216)), 6, '0') WHEN 1 THEN 'rgb(' || (event_id % 256) || ', 7, 9)' WHEN 2 THEN (event_id % 300) || ',10,20' WHEN 3 THEN '0.5,0.25,1' ELSE 'blue' END AS spec FROM events) SELECT event_id,"
    " CASE event_id % 5 WHEN 0 THEN event_id % 16777216 // 65536 WHEN 1 THEN event_id % 256 WHEN 2 THEN least(255, event_id % 300) WHEN 3 THEN 128 ELSE 128 END::INTEGER AS red, CASE event_id % 5 WHEN 0 THEN event_id % 65536 // 256 WHEN 1 THEN 7 WHEN 2 THEN 10 WHEN 3 THEN 64 ELSE 128 END::INTEGER AS green FROM s"
)
def s_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour texts of every form."""
    k = F.col("event_id")
    spec = F.when(k % 5 == 0, F.concat(F.when(k % 2 == 0, "#").otherwise(""), F.lpad(F.hex(k % 16777216), 6, "0"))).when(k % 5 == 1, F.concat(F.when(k % 2 == 0, "rgb(").otherwise("RGB( "), (k % 256).cast("string"), F.lit(", 7, 9)"))).when(k % 5 == 2, F.concat((k % 300).cast("string"), F.when(k % 2 == 0, ",10,20").otherwise(" 10  20"))).when(k % 5 == 3, F.lit("0.5,0.25,1")).otherwise(F.lit("blue"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", analysis.colour(spec).alias("c"))
    return e.select("event_id", F.col("c.r").alias("red"), F.col("c.g").alias("green"))


@query("WITH f AS (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders GROUP BY o_custkey), n AS (SELECT k, row_number() OVER (ORDER BY first, k) - 1 AS number FROM f) SELECT k AS id, (CASE WHEN k BETWEEN 0 AND 7 THEN k ELSE number % 8 END)::INTEGER AS colour FROM n")
def s_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette by id, else by first appearance."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return analysis.palette_index(o, "id", "o_orderkey")


@query("WITH g AS (SELECT l_suppkey AS facet, count(*) AS n FROM lineitem GROUP BY ALL) SELECT facet, n, coalesce(sum(n) OVER (ORDER BY facet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM g")
def s_vertex_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running vertex offsets of merged files."""
    g = cloud(spark, sf_dir, "pts").groupBy(F.col("grp").alias("facet")).agg(F.count("*").alias("n"))
    return analysis.vertex_offsets(g, "facet", "n")


@query("WITH p AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY ALL), e AS (SELECT k, unnest(ids) AS i, unnest(ids[2:] || ids[1:1]) AS j FROM p) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM e")
def s_loop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed loops of polygons as distinct undirected edges."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return analysis.distinct_edges(analysis.loop_edges(o, "o_custkey", "ids"))


@query(sql("parts") + " SELECT pid, printf('%.9f', x) || chr(9) || printf('%.9f', y) || chr(9) || printf('%.9f', z) || chr(9) || (pid % 7) || chr(9) || CASE WHEN pid % 3 = 0 THEN '-1' ELSE (pid % 3)::VARCHAR END || chr(9) || '-1' || chr(9) || 'nan' || chr(9) || 'nan' || chr(9) || 'nan' || chr(9) || 'nan' || chr(9) || printf('%.9f', y / 100) AS line FROM parts")
def s_facet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facet pipeline's text lines."""
    from strataspark.sources.tables import facet_lines

    none = F.lit(None).cast("double")
    p = cloud(spark, sf_dir, "parts").select("pid", "x", "y", "z", (F.col("pid") % 7).alias("cluster_id"), F.when(F.col("pid") % 3 != 0, F.col("pid") % 3).alias("subcluster_id"), F.lit(None).cast("int").alias("facet_id"), *[none.alias(k) for k in "abcd"], (F.col("y") / 100).alias("curvature"))
    return facet_lines(p, "pid")


@query(
    "WITH c AS (SELECT o_orderkey AS place, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey % 9 - 1 END::INTEGER AS cluster_id, (o_custkey % 4 - 1)::INTEGER AS sub, (o_custkey % 50 - 1)::INTEGER AS facet_id FROM orders),"
    " f AS (SELECT facet_id, row_number() OVER (ORDER BY min(place)) - 1 AS number FROM c WHERE cluster_id = -1 AND facet_id >= 0 GROUP BY facet_id), k AS (SELECT cluster_id, sub, row_number() OVER (ORDER BY min(place)) - 1 AS number FROM c WHERE cluster_id <> -1 AND sub <> -1 GROUP BY ALL)"
    " SELECT place, c.cluster_id, c.facet_id, CASE WHEN c.cluster_id = -1 THEN coalesce(f.number, -1) ELSE c.sub END::INTEGER AS subcluster_id, CASE WHEN c.cluster_id = -1 THEN CASE WHEN c.facet_id >= 0 THEN c.facet_id END ELSE k.number END::INTEGER AS combined_id"
    " FROM c LEFT JOIN f ON c.cluster_id = -1 AND f.facet_id = c.facet_id LEFT JOIN k ON k.cluster_id = c.cluster_id AND k.sub = c.sub"
)
def s_qfacet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet tables of texts: coercion, required columns, facets of no set as sub-clusters, combined ids."""
    from strataspark.sources.tables import qfacet

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = o.select(F.col("o_orderkey").alias("place"), *[F.lit("1.5").alias(c) for c in "XYZABCD"], F.when(F.col("o_orderkey") % 13 == 0, "x").otherwise((F.col("o_custkey") % 9 - 1).cast("string")).alias("cluster_id"), (F.col("o_custkey") % 4 - 1).cast("string").alias("subcluster_id"), (F.col("o_custkey") % 50 - 1).cast("string").alias("facet_id"))
    return qfacet(text, "place").select("place", "cluster_id", "facet_id", "subcluster_id", "combined_id")


