"""Queries over spatial joins, neighbourhoods and clusters, with the same for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.vec import vec
from strataspark.operators import cluster, facets, pairs, planes, spatial
from strataspark.operators.graph import cut_lineage
from strataspark.plans.clouds import NORMALS_SQL, cloud, normals, sql
from strataspark.plans.vectors import r

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def d2(p: str = "p", q: str = "q") -> str:
    return f"(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y) + ({p}.z - {q}.z) * ({p}.z - {q}.z))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir, "parts")


_KNN = f", k AS (SELECT pid, n_pid, d2, rank FROM (SELECT p.pid, q.pid AS n_pid, {d2()} AS d2, row_number() OVER (PARTITION BY p.pid ORDER BY {d2()}, q.pid) AS rank FROM parts p, parts q) WHERE rank <= "


@query(sql("parts") + _KNN + "8) SELECT pid, n_pid, rank, round(d2, 6) + 0.0 AS d2 FROM k")
def j1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest points, the point included."""
    p = _parts(spark, sf_dir)
    return spatial.knn(p, p, 8, 2.0).select("pid", "n_pid", "rank", r(F.col("d2"), "d2"))


@query(sql("parts") + f" SELECT p.pid, count(*)::BIGINT AS n, sum(q.pid)::BIGINT AS ids FROM parts p JOIN parts q ON {d2()} <= 4 GROUP BY p.pid")
def j2_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within a closed ball."""
    p = _parts(spark, sf_dir).select("pid", "x", "y", "z")
    return spatial.ball_sums(p, 2.0)


@query(sql("parts", "planes") + f", s AS (SELECT pid, 25 + a * 20 AS x, 12 + b * 5 AS y, 8 + c * 6 AS z, 2 + abs(d) / 4 AS rad FROM planes) SELECT p.pid, count(*)::BIGINT AS n, sum(q.pid)::BIGINT AS ids FROM s p JOIN parts q ON {d2()} <= p.rad * p.rad GROUP BY p.pid")
def j3_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spheres of their own radii joined with points."""
    s = cloud(spark, sf_dir, "planes").select("pid", (25 + F.col("a") * 20).alias("x"), (12 + F.col("b") * 5).alias("y"), (8 + F.col("c") * 6).alias("z"), (2 + F.abs("d") / 4).alias("rad"))
    return spatial.radius_join(s, _parts(spark, sf_dir).select("pid", "x", "y", "z"), F.col("rad"), 4.5).groupBy("pid").agg(F.count("*").alias("n"), F.sum("n_pid").alias("ids"))


@query(sql("disks") + f", b AS (SELECT pid, x, y, z, greatest(ra, rb) * 2 AS rad FROM disks) SELECT p.pid AS a, q.pid AS b, round({d2()}, 6) + 0.0 AS d2 FROM b p JOIN b q ON p.pid < q.pid AND {d2()} <= (p.rad + q.rad - 1e-9) * (p.rad + q.rad - 1e-9)")
def j4_ball_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balls that overlap."""
    b = cloud(spark, sf_dir, "disks").select("pid", "x", "y", "z", (F.greatest("ra", "rb") * 2).alias("r"))
    return spatial.ball_pairs(b, "pid", 8.0).select("a", "b", r(F.col("d2"), "d2"))


@query(sql("parts") + f" SELECT DISTINCT least(p.grp, q.grp) AS a, greatest(p.grp, q.grp) AS b FROM parts p JOIN parts q ON p.grp < q.grp AND {d2()} <= 0.25")
def j6_adjacent_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with points near each other."""
    return spatial.adjacent_owners(_parts(spark, sf_dir), "grp", 0.5)


@query(sql("parts") + f", c AS (SELECT grp, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM parts GROUP BY grp) SELECT DISTINCT p.grp AS a, q.grp AS b FROM parts p JOIN parts q ON p.grp < q.grp AND {d2()} <= 0.25 JOIN c s ON s.grp = p.grp JOIN c t ON t.grp = q.grp AND {d2('s', 't')} <= 4")
def j7_adjacent_near_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among groups of near centers."""
    p = _parts(spark, sf_dir)
    centers = p.groupBy("grp").agg(*[F.avg(a).alias(a) for a in "xyz"])
    return spatial.adjacent_owners_of_near_centers(p, centers, "grp", 0.5, 2.0)


@query("WITH " + NORMALS_SQL + ", c AS (SELECT pid AS center_id, x, y, z FROM nrm WHERE pid % 50 = 0) SELECT pid, center_id, round(s, 6) + 0.0 AS cosine FROM (SELECT n.pid, c.center_id, n.x * c.x + n.y * c.y + n.z * c.z AS s, row_number() OVER (PARTITION BY n.pid ORDER BY n.x * c.x + n.y * c.y + n.z * c.z DESC, c.center_id) AS k FROM nrm n, c) WHERE k = 1")
def j8_nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The center of greatest cosine."""
    n = normals(spark, sf_dir)
    c = n.where("pid % 50 = 0").select(F.col("pid").alias("center_id"), "x", "y", "z")
    return spatial.nearest_center(n, c).select("pid", "center_id", r(F.col("cosine"), "cosine"))


@query(
    sql("disks") + ", s AS (SELECT pid, x AS x1, y AS y1, x + a * 3 AS x2, y + b * 3 AS y2 FROM disks), t AS (SELECT p.pid AS a, q.pid AS b, p.x1, p.y1, p.x2, p.y2, q.x1 AS u1, q.y1 AS v1, q.x2 AS u2, q.y2 AS v2, (p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1) AS det FROM s p JOIN s q ON p.pid < q.pid)"
    " SELECT a, b FROM t WHERE abs(det) > 1e-12 AND ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / det BETWEEN -0.001 AND 1.001 AND ((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1)) / det BETWEEN -0.001 AND 1.001"
)
def j9_segment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of segments that cross in XY."""
    return pairs.segment_hits(_segments(spark, sf_dir), 5.0)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cloud(spark, sf_dir, "disks")
    end = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return d.select(F.col("pid").alias("id"), end(F.col("x"), F.col("y")).alias("p1"), end(F.col("x") + F.col("a") * 3, F.col("y") + F.col("b") * 3).alias("p2"))


_SLAB = sql("parts", "planes") + (
    ", f AS (SELECT grp AS facet, dense_rank() OVER (ORDER BY grp) AS k FROM (SELECT DISTINCT grp FROM parts)), pl AS (SELECT f.facet, p.a, p.b, p.c, -(p.a * 25 + p.b * 14 + p.c * 8) AS d FROM f JOIN planes p ON p.pid = f.k),"
    " m AS (SELECT a.facet AS a, q.grp AS i, q.pid, (a.a * q.x + a.b * q.y + a.c * q.z + a.d) / sqrt(a.a * a.a + a.b * a.b + a.c * a.c) AS s FROM pl a JOIN parts q ON q.grp <> a.facet), h AS (SELECT a, i, avg(CASE WHEN s < 0 AND s > -6 THEN 1.0 ELSE 0.0 END) AS share FROM m GROUP BY ALL)"
)


def _slabs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _parts(spark, sf_dir)
    from pyspark.sql import Window

    names = p.select(F.col("grp").alias("facet")).distinct().withColumn("k", F.row_number().over(Window.orderBy("facet")))  # a row a facet
    pl = names.join(cloud(spark, sf_dir, "planes").select(F.col("pid").alias("k"), "a", "b", "c"), "k").select("facet", "a", "b", "c", (-(F.col("a") * 25 + F.col("b") * 14 + F.col("c") * 8)).alias("d"))
    near = names.select(F.col("facet").alias("a")).join(names.select(F.col("facet").alias("i")), F.col("a") != F.col("i"))
    return pl, p.select(F.col("grp").alias("facet"), "pid", "x", "y", "z"), near


@query(_SLAB + " SELECT a, i FROM h WHERE share > 0")
def j10_slab_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours with a point in a facet's slab."""
    return pairs.slab_hits(*_slabs(spark, sf_dir), 6.0)


@query(_SLAB + " SELECT h.a, h.i AS b FROM h JOIN h g ON g.a = h.i AND g.i = h.a WHERE h.a < h.i AND h.share >= 0.2 AND g.share >= 0.2")
def j11_mutual_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets that hold enough of each other's points."""
    return pairs.mutual(pairs.inclusion(*_slabs(spark, sf_dir), 6.0), 0.2)


_CC = "WITH RECURSIVE "


@query(
    _CC + sql("parts")[5:] + f", e AS (SELECT p.pid AS a, q.pid AS b FROM parts p JOIN parts q ON {d2()} <= 0.25), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a AS pid, min(b) AS node FROM t GROUP BY a"
)
def j14_merge_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points merged along chains of near ones."""
    return pairs.merge_near(_parts(spark, sf_dir), 0.5).select("pid", "node")


@query(sql("parts") + f" SELECT DISTINCT q.pid FROM parts p JOIN parts q ON p.pid % 10 = 0 AND q.pid % 10 <> 0 AND {d2()} <= 1")
def j18_near_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near some point of another set."""
    p = _parts(spark, sf_dir)
    return pairs.near_other(p.where("pid % 10 = 0"), p.where("pid % 10 <> 0"), 1.0).select("pid")


@query(sql("parts", "disks") + f" SELECT pid, node FROM (SELECT p.pid, q.pid AS node, row_number() OVER (PARTITION BY p.pid ORDER BY {d2()}, q.pid) AS k FROM parts p, disks q) WHERE k = 1")
def j17_nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest point of another set, for every point."""
    return spatial.knn(_parts(spark, sf_dir), cloud(spark, sf_dir, "disks"), 1, 2.0).select("pid", F.col("n_pid").alias("node"))


# Grouped linear algebra

_MOM = ", m AS (SELECT {by} AS g, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(x, z) AS cxz, covar_pop(y, y) AS cyy, covar_pop(y, z) AS cyz, covar_pop(z, z) AS czz FROM {src} GROUP BY {by})"
_EIG = (
    ", q AS (SELECT *, (cxx + cyy + czz) / 3 AS q, cxy * cxy + cxz * cxz + cyz * cyz AS o FROM m), p AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * o) / 6) AS p FROM q),"
    " e AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, (((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (p * p * p)) / 2))) / 3 ELSE 0 END AS phi FROM p),"
    " l AS (SELECT *, greatest(0, q + 2 * p * cos(phi + 2 * pi() / 3)) AS l1, q + 2 * p * cos(phi) AS l3 FROM e), v AS (SELECT *, cxy * cyz - cxz * (cyy - l1) AS vx, cxz * cxy - (cxx - l1) * cyz AS vy, (cxx - l1) * (cyy - l1) - cxy * cxy AS vz FROM l), u AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS vn FROM v)"
)


@query(sql("pts") + _MOM.format(by="grp", src="pts") + _EIG + " SELECT g AS grp, n, round(l1 / greatest(cxx + cyy + czz, 1e-15), 5) + 0.0 AS curvature, round(degrees(acos(least(1, abs(vz / vn)))), 3) + 0.0 AS dip, round(sqrt(l1), 4) + 0.0 AS rms FROM u")
def agg_plane_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane for each group: curvature, dip, roughness (the flagship)."""
    p = cloud(spark, sf_dir, "pts")
    fits = planes.with_orientation(planes.fit_planes(p, ["grp"]))
    return fits.select("grp", "n", r(F.col("curvature"), "curvature", 5), r(F.col("dip"), "dip", 3), r(F.sqrt("l1"), "rms", 4))


@query(
    sql("pts") + _MOM.format(by="grp", src="pts") + _EIG + ", w AS (SELECT p.grp, (vx * (p.x - mx) + vy * (p.y - my) + vz * (p.z - mz)) / vn AS res FROM pts p JOIN u ON u.g = p.grp) SELECT grp, round(stddev_pop(res), 4) + 0.0 AS rms, round(max(res) - min(res), 3) + 0.0 AS zrange, round(max(abs(res)), 3) + 0.0 AS most FROM w GROUP BY grp"
)
def agg_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of fitted planes: deviation, range and greatest distance."""
    p = cloud(spark, sf_dir, "pts")
    res = planes.residuals(p, cut_lineage(planes.fit_planes(p, ["grp"])), ["grp"])
    return res.groupBy("grp").agg(r(F.stddev_pop("residual"), "rms", 4), r(F.max("residual") - F.min("residual"), "zrange", 3), r(F.max(F.abs("residual")), "most", 3))


@query(
    sql("parts") + _KNN + "12), nb AS (SELECT k.pid, q.x, q.y, q.z FROM k JOIN parts q ON q.pid = k.n_pid)" + _MOM.format(by="pid", src="nb") + _EIG + " SELECT g AS pid, round(l1 / greatest(cxx + cyy + czz, 1e-15), 4) + 0.0 AS curvature FROM u"
)
def agg_knn_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature of neighbourhoods of twelve points."""
    p = _parts(spark, sf_dir)
    near = spatial.knn(p, p, 12, 2.0).join(p.select(F.col("pid").alias("n_pid"), *[F.col(a).alias(f"n_{a}") for a in "xyz"]), "n_pid")
    return planes.neighbour_planes(near).select("pid", r(F.col("curvature"), "curvature", 4))


@query(
    sql("parts") + f", nb AS (SELECT p.pid, q.x, q.y, q.z FROM parts p JOIN parts q ON {d2()} <= 9)" + _MOM.format(by="pid", src="nb") + _EIG + ", c AS (SELECT g AS pid, CASE WHEN n < 10 THEN 0 ELSE l1 / greatest(cxx + cyy + czz, 1e-15) END AS k FROM u) SELECT round(min(k), 4) + 0.0 AS low, round(quantile_cont(k, 0.5), 4) + 0.0 AS p50, round(quantile_cont(k, 0.95), 4) + 0.0 AS p95, round(max(k), 4) + 0.0 AS high, sum(CASE WHEN k > 0.02 THEN 1 ELSE 0 END)::BIGINT AS edges FROM c"
)
def agg_radius_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature of balls, its summary, and how many points are boundary."""
    p = _parts(spark, sf_dir).select("pid", "x", "y", "z")
    m = cut_lineage(spatial.ball_moments(p, 3.0))
    c = cut_lineage(planes.with_plane(m).select("weight", F.when(F.col("n") < 10, 0.0).otherwise(F.col("curvature")).alias("curvature")))  # a row a place
    q = F.percentile("curvature", F.array(F.lit(0.5), F.lit(0.95)), F.col("weight"))
    return c.agg(r(F.min("curvature"), "low", 4), r(q[0], "p50", 4), r(q[1], "p95", 4), r(F.max("curvature"), "high", 4), F.sum(F.when(F.col("curvature") > 0.02, F.col("weight")).otherwise(0)).alias("edges"))


@query(sql("parts") + _KNN + "7) SELECT round(quantile_cont(d, 0.5), 5) + 0.0 AS spacing, round((SELECT quantile_cont(sqrt(d2), 0.9) FROM k WHERE rank = 6), 5) + 0.0 AS eps FROM (SELECT sqrt(d2) AS d FROM k WHERE rank = 2)")
def agg_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median distance to the nearest point, and a quantile of that to the fifth."""
    p = _parts(spark, sf_dir)
    near = cut_lineage(spatial.knn(p, p, 7, 2.0))
    eps = cluster.eps_by_neighbours(p, 5, 0.9, 2.0)
    return near.where("rank = 2").agg(r(F.percentile(F.sqrt("d2"), F.lit(0.5)), "spacing", 5)).crossJoin(eps.select(r(F.col("eps"), "eps", 5)))


@query(sql("parts") + _KNN + "9), m AS (SELECT pid, avg(sqrt(d2)) AS d FROM k WHERE rank > 1 GROUP BY pid), s AS (SELECT p.grp, 1 / (m.d + 1e-8) AS w FROM m JOIN parts p USING (pid)) SELECT grp, round(stddev_pop(w) / avg(w), 5) + 0.0 AS uniformity FROM s GROUP BY grp")
def agg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniformity of the density of each group, by the mean distance to eight neighbours."""
    p = _parts(spark, sf_dir)
    m = spatial.knn(p, p, 9, 2.0).where("rank > 1").groupBy("pid").agg((1 / (F.avg(F.sqrt("d2")) + 1e-8)).alias("w"))
    return m.join(p.select("pid", "grp"), "pid").groupBy("grp").agg(r(F.stddev_pop("w") / F.avg("w"), "uniformity", 5))


@query(sql("parts") + " SELECT grp, min(x) AS x0, max(x) AS x1, round(sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))), 6) + 0.0 AS diagonal, round(avg(y), 6) + 0.0 AS cy, round(min(z) - 0.05, 6) + 0.0 AS low, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM parts GROUP BY grp")
def agg_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, diagonals, padded envelopes, centroids and shares of groups."""
    p = _parts(spark, sf_dir)
    g = p.groupBy("grp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.avg("y").alias("cy"), F.count("*").alias("n"))
    total = p.agg(F.count("*").alias("all"))
    size = vec(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0"))
    return g.crossJoin(F.broadcast(total)).select("grp", "x0", "x1", r(size.norm(), "diagonal"), r(F.col("cy"), "cy"), r(F.col("z0") - 0.05, "low"), (F.col("n").cast("double") / F.col("all")).alias("share"))


@query("WITH " + NORMALS_SQL + ", c AS (SELECT grp, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nrm GROUP BY grp), u AS (SELECT grp, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM c) SELECT p.grp AS a, q.grp AS b, round(degrees(acos(greatest(-1, least(1, p.x * q.x + p.y * q.y + p.z * q.z)))), 4) + 0.0 AS degrees FROM u p JOIN u q ON p.grp < q.grp")
def agg_center_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles between the mean directions of the sets."""
    from strataspark.functions.vec import angle, unit

    c = normals(spark, sf_dir).groupBy("grp").agg(*[F.avg(a).alias(a) for a in "xyz"])
    u = c.select("grp", *[v.alias(a) for v, a in zip(unit(vec("x", "y", "z")).parts(), "xyz", strict=True)])
    other = u.select(F.col("grp").alias("b"), *[F.col(a).alias(f"n{a}") for a in "xyz"])
    return u.join(other, F.col("grp") < F.col("b")).select(F.col("grp").alias("a"), "b", r(F.degrees(angle(vec("x", "y", "z"), vec("nx", "ny", "nz"))), "degrees", 4))


@query("WITH " + NORMALS_SQL + ", b AS (SELECT floor((atan2(y, x) + pi()) / radians(30))::BIGINT AS az, floor((asin(z) + pi() / 2) / radians(30))::BIGINT AS el, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM nrm GROUP BY ALL) SELECT az, el, n, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS x FROM b")
def agg_direction_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions by cells of azimuth and elevation."""
    return cluster.direction_bins(normals(spark, sf_dir), 30.0).select("az", "el", "n", r(F.col("x"), "x"))


@query(sql("pts") + ", l AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts) SELECT floor((x - lx) / 5)::BIGINT AS i, floor((y - ly) / 5)::BIGINT AS j, floor((z - lz) / 5)::BIGINT AS k, count(*) AS n, round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y FROM pts, l GROUP BY ALL")
def agg_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxel down-sampling."""
    return spatial.voxel_downsample(cloud(spark, sf_dir, "pts"), 5.0).select("i", "j", "k", "n", r(F.col("x"), "x", 4), r(F.col("y"), "y", 4))


@query(
    sql("pts") + ", l AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts), q AS (SELECT pid, x, x - lx AS qx, y - ly AS qy, z - lz AS qz FROM pts, l), w AS (SELECT unnest(range(0, 60)) AS i), a AS (SELECT x, qy, qz, w.i AS i FROM q JOIN w ON qx >= w.i * 6 AND qx < w.i * 6 + 8), b AS (SELECT a.x, a.qz, a.i, w.i AS j FROM a JOIN w ON qy >= w.i * 6 AND qy < w.i * 6 + 8), c AS (SELECT b.x, b.i, b.j, w.i AS k FROM b JOIN w ON qz >= w.i * 6 AND qz < w.i * 6 + 8)"
    " SELECT i, j, k, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x FROM c GROUP BY ALL HAVING count(*) >= 20"
)
def t2_sliding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping cubes."""
    return spatial.tiles(cloud(spark, sf_dir, "pts"), 8.0, 2.0, 20).select("i", "j", "k", "n_points", "min_x", "max_x")


@query(sql("pts") + ", l AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts) SELECT floor((x - lx) / 7)::BIGINT AS i, floor((y - ly) / 7)::BIGINT AS j, floor((z - lz) / 7)::BIGINT AS k, count(*) AS n_points, min(y) AS min_y, max(z) AS max_z FROM pts, l GROUP BY ALL HAVING count(*) >= 100")
def t1_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes side by side, with the manifest's counts and boxes."""
    return spatial.tiles(cloud(spark, sf_dir, "pts"), 7.0, 0.0, 100).select("i", "j", "k", "n_points", "min_y", "max_z")


@query(
    sql("parts") + _KNN + f"9), m AS (SELECT pid, avg(sqrt(d2)) AS d FROM k WHERE n_pid <> pid GROUP BY pid), s AS (SELECT avg(d) + 1.0 * stddev_samp(d) AS lim FROM m), w AS (SELECT p.pid FROM parts p JOIN parts q ON p.pid <> q.pid AND {d2()} <= 4 GROUP BY p.pid HAVING count(*) >= 4) SELECT m.pid FROM m JOIN w USING (pid), s WHERE d <= lim"
)
def f11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that the statistical and the radius filter keep."""
    return spatial.outliers(_parts(spark, sf_dir).select("pid", "x", "y", "z"), 8, 1.0, 2.0, 4, 2.0).select("pid")


# Clusters


@query("WITH " + NORMALS_SQL + f", m AS (SELECT p.pid, sum(q.x) AS x, sum(q.y) AS y, sum(q.z) AS z, count(*) AS n FROM nrm p JOIN nrm q ON {d2()} <= {2 * math.sin(math.radians(15) / 2)!r} * {2 * math.sin(math.radians(15) / 2)!r} GROUP BY p.pid) SELECT pid, n, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS x, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS z FROM m")
def c1_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-shift modes on the sphere."""
    return cluster.modes(normals(spark, sf_dir), 15.0).select("pid", "n", r(F.col("x"), "x"), r(F.col("z"), "z"))


@query()
def c2_direction_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction sets: modes, the greedy merge, the nearest center (an ordered fold; tests hold it to brute force)."""
    labels, _ = cluster.direction_sets(normals(spark, sf_dir), 15.0, 5.0)
    return labels.groupBy("center_id").agg(F.count("*").alias("n"))


@query()
def c4_grid_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction sets by cells."""
    labels, _ = cluster.direction_sets(normals(spark, sf_dir), mode="grid")
    return labels.groupBy("center_id").agg(F.count("*").alias("n"))


@query(
    _CC + sql("parts")[5:] + f", e AS (SELECT p.pid AS a, q.pid AS b FROM parts p JOIN parts q ON {d2()} <= 2.25), c AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 6), l AS (SELECT e.a, e.b FROM e JOIN c ON c.a = e.a JOIN c d ON d.a = e.b), t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a), o AS (SELECT a, min(b) AS root FROM t GROUP BY a),"
    " n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM o)), g AS (SELECT e.a AS pid, coalesce(max(s.root), min(o.root)) AS root FROM e JOIN o ON o.a = e.b LEFT JOIN o s ON s.a = e.a GROUP BY e.a) SELECT p.pid, n.cluster::INTEGER AS cluster FROM parts p LEFT JOIN g ON g.pid = p.pid LEFT JOIN n ON n.root = g.root"
)
def c6_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSCAN over a cloud."""
    return cluster.dbscan(_parts(spark, sf_dir).select("pid", "x", "y", "z"), 1.5, 6).select("pid", F.col("cluster").cast("int").alias("cluster"))


@query(
    _CC + sql("planes")[5:] + ", u AS (SELECT pid, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z, d / 10 AS w FROM planes), e AS (SELECT p.pid AS a, q.pid AS b FROM u p JOIN u q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) + (p.w - q.w) * (p.w - q.w) <= 0.16), c AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 3),"
    " l AS (SELECT e.a, e.b FROM e JOIN c ON c.a = e.a JOIN c d ON d.a = e.b), t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a) SELECT a AS pid, min(b) AS root FROM t GROUP BY a"
)
def c7_dbscan_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core points of DBSCAN over normals and offsets, four axes."""
    from strataspark.functions.vec import unit

    p = cloud(spark, sf_dir, "planes")
    f = p.select("pid", *[v.alias(a) for v, a in zip(unit(vec("a", "b", "c")).parts(), "xyz", strict=True)], (F.col("d") / 10).alias("w"))
    told = cut_lineage(cluster.dbscan(f, 0.4, 3, axes=("x", "y", "z", "w"), with_core=True))
    named = told.where("core")
    return named.join(named.groupBy("cluster").agg(F.min("pid").alias("root")), "cluster").select("pid", "root")


@query()
def c9_set_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets by angles, an ordered fold."""
    return cluster.set_grouping(normals(spark, sf_dir)).groupBy("set").agg(F.count("*").alias("n"))


@query()
def c10_kmeans_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many direction clusters a cloud has."""
    return cluster.kmeans_choice(normals(spark, sf_dir))


@query()
def c12_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from a cloud to facets."""
    p = _parts(spark, sf_dir).select("pid", "x", "y", "z")
    return facets.from_cloud(p, k=12, most_curvature=0.2, least_group=20, flat_degrees=20, least_core=5, cell=2.0).select("pid", "cluster_id", "subcluster_id", "facet_id")


@query(
    sql("parts") + ", " + f"n AS (SELECT pid, x, y, z, cos(pid) AS nx, sin(pid) * cos(x) AS ny, sin(pid) * sin(x) AS nz FROM parts), b AS (SELECT p.pid, q.nx, q.ny, q.nz FROM n p JOIN n q ON {d2()} <= 2.25), s AS (SELECT pid, count(*) AS m FROM b GROUP BY pid), w AS (SELECT b.pid, min(b.nx * c.nx + b.ny * c.ny + b.nz * c.nz) AS dot FROM b JOIN b c ON b.pid = c.pid GROUP BY b.pid)"
    " SELECT pid, CASE WHEN m >= 5 THEN round(degrees(acos(greatest(-1, least(1, dot)))), 4) + 0.0 END AS spread, coalesce(m >= 5 AND degrees(acos(greatest(-1, least(1, dot)))) >= 100, false) AS boundary FROM s JOIN w USING (pid)"
)
def k13_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary points by the spread of normals in their neighbourhood."""
    pid = F.col("pid").cast("double")
    n = _parts(spark, sf_dir).select("pid", "x", "y", "z", F.cos(pid).alias("nx"), (F.sin(pid) * F.cos("x")).alias("ny"), (F.sin(pid) * F.sin("x")).alias("nz"))
    return facets.boundary_by_normals(n, 1.5, 100.0, 5).select("pid", r(F.col("spread"), "spread", 4), "boundary")


@query()
def k12_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals turned alike along a spanning forest."""
    n = normals(spark, sf_dir)
    near = spatial.knn(n, n, 6, 0.3).where("pid <> n_pid").select(F.col("pid").alias("a"), F.col("n_pid").alias("b"))
    return facets.propagate_orientation(n, near).groupBy("sign").count()


