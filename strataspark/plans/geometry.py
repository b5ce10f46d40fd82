"""Queries over facets, RANSAC, graphs, blocks and synthetic clouds, with the same for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.vec import basis_by_x, unit, vec
from strataspark.operators import blocks, facets, graph, pairs, planes, ransac
from strataspark.operators.graph import cut_lineage
from strataspark.operators.spatial import radius_join
from strataspark.plans.clouds import cloud, sql
from strataspark.plans.spatial import _EIG, _MOM
from strataspark.plans.vectors import r

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of points in a plane: grp, pid, s, t."""
    return cloud(spark, sf_dir, "parts").select("grp", "pid", F.col("x").alias("s"), F.col("y").alias("t"))


# A pair of points is an edge of the hull if no point lies to its right; the corners are the edges' first points.
_HULL = ", d AS (SELECT DISTINCT grp, x AS s, y AS t FROM parts), h AS (SELECT p.grp, p.s, p.t, q.s AS s2, q.t AS t2 FROM d p JOIN d q ON q.grp = p.grp AND (p.s <> q.s OR p.t <> q.t) WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.grp = p.grp AND ((q.s - p.s) * (o.t - p.t) - (q.t - p.t) * (o.s - p.s) < -1e-9 OR (abs((q.s - p.s) * (o.t - p.t) - (q.t - p.t) * (o.s - p.s)) <= 1e-9 AND (o.s - p.s) * (o.s - q.s) + (o.t - p.t) * (o.t - q.t) > 1e-9))))"


@query(sql("parts") + _HULL + " SELECT grp, count(*) AS corners, round(sum(s * t2 - s2 * t) / 2, 4) + 0.0 AS area FROM h GROUP BY grp")
def k2_hull_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex polygons and their areas."""
    return facets.hull_polygons(_flat(spark, sf_dir), "grp").select("grp", F.size("s").cast("long").alias("corners"), r(F.col("area"), "area", 4))


@query(sql("parts") + " SELECT p.grp, round(max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 6) + 0.0 AS length FROM parts p JOIN parts q ON p.grp = q.grp GROUP BY p.grp")
def k4_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest distance of each polygon, which is that of the group."""
    polygons = cut_lineage(facets.hull_polygons(_flat(spark, sf_dir), "grp"))
    return facets.traces(polygons, "grp").select("grp", r(F.col("length"), "length"))


_D = "(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) + ({a}.z - {b}.z) * ({a}.z - {b}.z))"


@query(
    sql("parts") + ", o AS (SELECT grp, arg_min(x, pid) AS x, arg_min(y, pid) AS y, arg_min(z, pid) AS z FROM parts GROUP BY grp), e AS (SELECT grp, pid, x, y, z FROM (SELECT p.*, row_number() OVER (PARTITION BY p.grp ORDER BY " + _D.format(a="p", b="o") + " DESC, p.pid) AS k FROM parts p JOIN o ON o.grp = p.grp) WHERE k = 1)"
    " SELECT grp, v1, v2, round(sqrt(d), 6) + 0.0 AS length FROM (SELECT p.grp, e.pid AS v1, p.pid AS v2, " + _D.format(a="p", b="e") + " AS d, row_number() OVER (PARTITION BY p.grp ORDER BY " + _D.format(a="p", b="e") + " DESC, p.pid) AS k FROM parts p JOIN e ON e.grp = p.grp) WHERE k = 1"
)
def k5_farthest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces by two farthest steps."""
    return facets.farthest_twice(cloud(spark, sf_dir, "parts"), "grp").select("grp", "v1", "v2", r(F.col("length"), "length"))


_FACETS = (
    sql("parts") + _MOM.format(by="grp", src="parts") + _EIG + ", f AS (SELECT g, n, mx, my, mz, vx / vn AS nx, vy / vn AS ny, vz / vn AS nz FROM u), bs AS (SELECT *, sqrt(nx * nx + ny * ny) AS k FROM f), bu AS (SELECT *, ny / k AS ux, -nx / k AS uy FROM bs), bv AS (SELECT *, -nz * uy AS wx, nz * ux AS wy, nx * uy - ny * ux AS wz FROM bu),"
    " pr AS (SELECT p.grp, (p.x - mx) * ux + (p.y - my) * uy AS s, (p.x - mx) * wx + (p.y - my) * wy + (p.z - mz) * wz AS t, (p.x - mx) * nx + (p.y - my) * ny + (p.z - mz) * nz AS res FROM parts p JOIN bv ON bv.g = p.grp)"
    + _HULL.replace("SELECT DISTINCT grp, x AS s, y AS t FROM parts", "SELECT DISTINCT grp, s, t FROM pr")
    + ", ar AS (SELECT grp, sum(s * t2 - s2 * t) / 2 AS area FROM h GROUP BY grp), tr AS (SELECT a.grp, sqrt(max((a.s - b.s) * (a.s - b.s) + (a.t - b.t) * (a.t - b.t))) AS trace FROM h a JOIN h b ON b.grp = a.grp GROUP BY a.grp), rs AS (SELECT grp, stddev_pop(res) AS rms FROM pr GROUP BY grp)"
    " SELECT f.g AS grp, f.n, round(degrees(acos(least(1, abs(nz)))), 4) + 0.0 AS dip, round(area, 4) + 0.0 AS area, round(trace, 4) + 0.0 AS trace_length, round(trace / 2, 4) + 0.0 AS ellip_a, round(area / (pi() * trace / 2), 4) + 0.0 AS ellip_b, round(rms, 4) + 0.0 AS rms, true AS valid FROM f JOIN ar ON ar.grp = f.g JOIN tr ON tr.grp = f.g JOIN rs ON rs.grp = f.g"
)


@query(_FACETS)
def k9_characterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of each facet."""
    c = facets.characterise(cloud(spark, sf_dir, "parts"), "grp")
    return c.select("grp", "n", r(F.col("dip"), "dip", 4), r(F.col("area"), "area", 4), r(F.col("trace_length"), "trace_length", 4), r(F.col("ellip_a"), "ellip_a", 4), r(F.col("ellip_b"), "ellip_b", 4), r(F.col("rms"), "rms", 4), "valid")


@query()
def k3_alpha_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha shapes of the groups."""
    p = facets.hull_polygons(_flat(spark, sf_dir), "grp", method="ashape", alpha=0.1)
    return p.select("grp", F.size("s").alias("corners"), r(F.col("area"), "area", 4))


@query(sql("disks") + ", v AS (SELECT unnest(range(0, 61)) AS vid) SELECT pid, vid, round(x + CASE WHEN vid > 0 THEN ra * cos((vid - 1) * (2 * pi() / 60)) ELSE 0 END, 5) + 0.0 AS px, round(y + CASE WHEN vid > 0 THEN rb * sin((vid - 1) * (2 * pi() / 60)) ELSE 0 END, 5) + 0.0 AS py FROM disks, v")
def k10_tessellate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks as fans of sixty triangles."""
    d = cloud(spark, sf_dir, "disks").select("pid", vec("x", "y", "z").struct().alias("center"), vec(1, 0, 0).struct().alias("u"), vec(0, 1, 0).struct().alias("v"), F.col("ra").alias("a"), F.col("rb").alias("b"))
    return facets.tessellate(d, "pid").select("pid", "vid", r(F.col("x"), "px", 5), r(F.col("y"), "py", 5))


@query()
def k15_tin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of each group."""
    return facets.tin(cloud(spark, sf_dir, "parts"), "grp").groupBy("grp").agg(F.count("*").alias("n"))


# Segments of disks

_U = "sqrt(a * a + b * b + c * c)"


@query(
    sql("disks") + f", n AS (SELECT pid, x, y, z, a / {_U} AS nx, b / {_U} AS ny, c / {_U} AS nz, ra, rb FROM disks), hx AS (SELECT *, CASE WHEN abs(nx) >= 0.9 THEN -nz ELSE 0 END AS ax, CASE WHEN abs(nx) >= 0.9 THEN 0 ELSE nz END AS ay, CASE WHEN abs(nx) >= 0.9 THEN nx ELSE -ny END AS az FROM n), u AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS l FROM hx), f AS (SELECT pid, x, y, z, nx, ny, nz, ra, rb, ax / l AS ux, ay / l AS uy, az / l AS uz FROM u), g AS (SELECT *, ny * uz - nz * uy AS vx, nz * ux - nx * uz AS vy, nx * uy - ny * ux AS vz FROM f),"
    " p AS (SELECT s.pid AS i, t.pid AS j, s.ny * t.nz - s.nz * t.ny AS lx, s.nz * t.nx - s.nx * t.nz AS ly, s.nx * t.ny - s.ny * t.nx AS lz, s.nx * s.x + s.ny * s.y + s.nz * s.z AS d1, t.nx * t.x + t.ny * t.y + t.nz * t.z AS d2, s.nx AS n1, s.ny AS n2, s.nz AS n3, t.nx AS m1, t.ny AS m2, t.nz AS m3 FROM g s JOIN g t ON s.pid < t.pid AND (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) <= (2 * greatest(s.ra, s.rb) + 2 * greatest(t.ra, t.rb)) * (2 * greatest(s.ra, s.rb) + 2 * greatest(t.ra, t.rb))),"
    " q AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS ll FROM p), w AS (SELECT i, j, lx / ll AS dx, ly / ll AS dy, lz / ll AS dz, (d1 * (m2 * lz - m3 * ly) + d2 * (ly * n3 - lz * n2)) / (ll * ll) AS px, (d1 * (m3 * lx - m1 * lz) + d2 * (lz * n1 - lx * n3)) / (ll * ll) AS py, (d1 * (m1 * ly - m2 * lx) + d2 * (lx * n2 - ly * n1)) / (ll * ll) AS pz FROM q WHERE ll >= 1e-8),"
    " k AS (SELECT w.i, w.j, g.pid, (dx * ux + dy * uy + dz * uz) / ra AS e, (dx * vx + dy * vy + dz * vz) / rb AS h, ((px - x) * ux + (py - y) * uy + (pz - z) * uz) / ra AS s0, ((px - x) * vx + (py - y) * vy + (pz - z) * vz) / rb AS t0 FROM w JOIN g ON g.pid IN (w.i, w.j)), c AS (SELECT i, j, pid, e * e + h * h AS qa, 2 * (s0 * e + t0 * h) AS qb, s0 * s0 + t0 * t0 - 1 AS qc FROM k), o AS (SELECT i, j, (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS lo, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS hi FROM c WHERE qb * qb - 4 * qa * qc >= 0)"
    " SELECT i AS a, j AS b, round(min(hi) - max(lo), 4) + 0.0 AS length FROM o WHERE hi - lo > 1e-9 GROUP BY i, j HAVING count(*) = 2 AND min(hi) - max(lo) > 1e-6"
)
def b5_disk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common segments of every two disks."""
    d = cloud(spark, sf_dir, "disks")
    n = unit(vec("a", "b", "c"))
    framed = d.select(F.col("pid").alias("id"), vec("x", "y", "z").struct().alias("center"), n.struct().alias("n"), "ra", "rb")
    u, v = basis_by_x(vec(F.col("n.x"), F.col("n.y"), F.col("n.z")))
    disks = cut_lineage(framed.select("*", u.struct().alias("u"), v.struct().alias("v")))
    return pairs.disk_segments(disks, 4.0).select("a", "b", r(F.col("length"), "length", 4))


# RANSAC


def _lcg(e: str) -> str:
    return f"(({e}) * 1103515245 + 12345) % 2147483648"


_RANSAC = sql("parts") + (
    ", n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pid) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS size FROM parts), g AS (SELECT grp, max(size) AS size FROM n GROUP BY grp), i AS (SELECT grp, size, unnest(range(0, 60)) AS iter FROM g WHERE size >= 3),"
    f" s1 AS (SELECT *, {_lcg(_lcg('iter * 3 + 1'))} AS s1 FROM i), s2 AS (SELECT *, {_lcg('s1')} AS s2 FROM s1), s3 AS (SELECT *, {_lcg('s2')} AS s3 FROM s2),"
    " t AS (SELECT s3.grp, iter, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM s3 JOIN n a ON a.grp = s3.grp AND a.rank = (s1 // 65536) % s3.size JOIN n b ON b.grp = s3.grp AND b.rank = (s2 // 65536) % s3.size JOIN n c ON c.grp = s3.grp AND c.rank = (s3 // 65536) % s3.size),"
    " m AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM t), h AS (SELECT grp, iter, nx / l AS a, ny / l AS b, nz / l AS c, -(nx / l * ax + ny / l * ay + nz / l * az) AS d FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM m) WHERE l > 1e-9),"
    " k AS (SELECT h.grp, iter, count(*) AS inliers FROM h JOIN parts p ON p.grp = h.grp AND abs(a * x + b * y + c * z + d) <= 0.8 GROUP BY ALL), w AS (SELECT grp, iter, inliers FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY inliers DESC, iter) AS r FROM k) WHERE r = 1)"
)


@query(_RANSAC + " SELECT w.grp, w.iter, w.inliers, g.size, w.inliers::DOUBLE / g.size > 0.2 AND w.inliers > 15 AS accepted FROM w JOIN g ON g.grp = w.grp")
def r1_best_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of sixty planes for each group, and whether the group is accepted."""
    p = cloud(spark, sf_dir, "parts")
    best = cut_lineage(ransac.best_planes(p, ["grp"], 0.8, 60).select("grp", "iter", "inliers"))
    sized = best.join(p.groupBy("grp").agg(F.count("*").alias("size")), "grp")
    ok = ransac.accept(sized, 0.2, 15).select("grp", F.lit(True).alias("ok"))
    return sized.join(ok, "grp", "left").select("grp", F.col("iter").cast("long").alias("iter"), "inliers", "size", F.coalesce("ok", F.lit(False)).alias("accepted"))


@query()
def r3_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two planes a group, each refitted to its inliers, with the criterion."""
    found = ransac.peel(cloud(spark, sf_dir, "parts"), ["grp"], 2, 0.8, 60, 10)
    return found.groupBy("grp").agg(F.count("*").alias("planes"), F.sum("inliers").alias("inliers"), r(planes.bic(F.sum("rss"), F.sum("inliers"), F.count("*")), "bic", 3))


# Graphs

_T = ", t AS (SELECT a, b FROM f UNION SELECT t.a, f.b FROM t JOIN f ON t.b = f.a)"


@query("WITH RECURSIVE " + sql("sparse_edges")[5:] + ", f AS (SELECT a, b FROM sparse_edges WHERE a <> b UNION SELECT b, a FROM sparse_edges WHERE a <> b)" + _T + " SELECT a AS node, least(a, min(b)) AS component FROM t GROUP BY a")
def g1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components."""
    return graph.components(cloud(spark, sf_dir, "sparse_edges"))


_E = sql("edges") + ", e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM edges WHERE a <> b)"


@query(_E + " SELECT p.a, p.b, q.b AS c FROM e p JOIN e q ON p.a = q.a AND p.b < q.b JOIN e s ON s.a = p.b AND s.b = q.b")
def g5_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles."""
    return graph.triangles(cloud(spark, sf_dir, "edges"))


@query(
    sql("planes") + ", c AS (SELECT pid, [pid % 9, 9 + pid % 7, 16 + pid % 5] AS t FROM planes) SELECT p.pid AS a, q.pid AS b FROM c p JOIN c q ON p.pid < q.pid AND len(list_intersect(p.t, q.t)) >= 2"
)
def g6_corner_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners that share two planes."""
    p = F.col("pid")
    c = cloud(spark, sf_dir, "planes").select(F.col("pid").alias("corner"), F.array(p % 9, 9 + p % 7, 16 + p % 5).alias("planes"))
    return graph.share_two(c)


@query(
    sql("planes") + ", n AS (SELECT pid, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM planes) SELECT count(*)::BIGINT - 1 AS edges FROM n"
)
def g2_spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minimum spanning tree over the normals of all planes (its number of edges; tests hold its weight to brute
    force)."""
    return axis_tree(_normals(spark, sf_dir)).agg(F.count("*").alias("edges"))


# The next edge of the tree is the least one between parts; lab holds each plane's part.
@query(
    sql("planes").replace("WITH ", "WITH RECURSIVE ", 1) + ", n AS (SELECT pid, row_number() OVER (ORDER BY pid) AS k, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM planes),"
    " e AS (SELECT p.pid AS a, q.pid AS b, p.k AS ka, q.k AS kb, round(1 - abs(p.x * q.x + p.y * q.y + p.z * q.z), 9) AS w FROM n p JOIN n q ON p.pid < q.pid),"
    " t AS (SELECT range(1, (SELECT count(*) FROM n) + 1) AS lab, NULL::STRUCT(w DOUBLE, a BIGINT, b BIGINT, ka BIGINT, kb BIGINT) AS e UNION ALL SELECT list_transform(t.lab, lambda l: CASE WHEN l = t.lab[q.e.kb] THEN t.lab[q.e.ka] ELSE l END), q.e FROM t, (SELECT min(struct_pack(w := e.w, a := e.a, b := e.b, ka := e.ka, kb := e.kb)) AS e FROM e, t WHERE t.lab[e.ka] <> t.lab[e.kb]) q WHERE q.e IS NOT NULL)"
    " SELECT e.a AS a, e.b AS b, e.w AS w FROM t WHERE e IS NOT NULL"
)
def g2_tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of that tree."""
    return axis_tree(_normals(spark, sf_dir))


def _normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = unit(vec("a", "b", "c"))
    return cloud(spark, sf_dir, "planes").select("pid", *[c.alias(k) for k, c in zip("xyz", n.parts(), strict=True)])


def axis_tree(normals: DataFrame) -> DataFrame:
    """(a, b, w) of the minimum spanning tree over all normals (pid, x, y, z), w = 1 - |n.n'|, ties by (w, a, b).

    Edges up to a bound of w give the tree's edges up to that bound; while several components are left the bound
    grows fourfold, for pairs between components only, until it is 1, which every pair is within."""
    p = cut_lineage(normals.where("x IS NOT NULL"))
    n = p.count()
    most, tree = min(1.0, 16 / max(n, 1)), None
    label = p.select(F.col("pid").alias("node"), F.col("pid").alias("component"))
    dot = vec("x", "y", "z").dot(vec("n_x", "n_y", "n_z"))
    while True:
        held = cut_lineage(p.join(label, F.col("pid") == F.col("node")).drop("node"))
        axes = held.unionByName(held.select("pid", *[(-F.col(c)).alias(c) for c in "xyz"], "component"))
        near = radius_join(held, axes, math.sqrt(2 * most) + 1e-6).where("component <> n_component")  # |n - n'|^2 = 2 w
        edges = near.select(F.least("pid", "n_pid").alias("a"), F.greatest("pid", "n_pid").alias("b"), F.round(1 - F.abs(dot), 9).alias("w")).where(F.col("w") <= most)
        tree = cut_lineage(graph.spanning_forest(edges if tree is None else edges.unionByName(tree), most_small=250_000))
        if most >= 1 or tree.count() >= n - 1:
            return tree
        label = graph.components(tree.select("a", "b"), p.select(F.col("pid").alias("node")))
        most = min(1.0, 4 * most)


_NEAR = (
    sql("planes").replace("WITH ", "WITH RECURSIVE ", 1) + ", n AS (SELECT pid, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM planes), t AS (SELECT p.pid AS a, q.pid AS b FROM n p JOIN n q ON p.pid <> q.pid AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 0.0625),"
    " k AS (SELECT [a, b] AS c FROM t WHERE a < b UNION ALL SELECT list_append(k.c, t.b) FROM k JOIN t ON t.a = k.c[1] AND t.b > k.c[-1] WHERE (SELECT count(*) FROM t s WHERE s.a = t.b AND list_contains(k.c, s.b)) = len(k.c)),"
    " j AS (SELECT k.c, s.b AS other, count(*) AS hits FROM k JOIN t s ON list_contains(k.c, s.a) GROUP BY k.c, s.b), o AS (SELECT DISTINCT c FROM j WHERE hits = len(c))"
    " SELECT k.c[1] AS first, k.c[-1] AS last, len(k.c)::BIGINT AS n, list_sum(k.c)::BIGINT AS ids FROM k ANTI JOIN o ON o.c = k.c WHERE len(k.c) >= 3"
)


@query(_NEAR)
def g3_maximal_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal cliques of planes with normals near each other."""
    n = _normals(spark, sf_dir)
    near = radius_join(n, n, 0.25).where("pid < n_pid").select(F.col("pid").alias("a"), F.col("n_pid").alias("b"))
    c = graph.maximal_cliques(near)
    return c.select(F.array_min("clique").alias("first"), F.array_max("clique").alias("last"), F.size("clique").cast("long").alias("n"), F.aggregate("clique", F.lit(0).cast("long"), lambda a, v: a + v).alias("ids"))


@query()
def g3_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive cliques of planes with normals near each other, a component at a time."""
    n = _normals(spark, sf_dir)
    near = radius_join(n, n, 0.15).where("pid < n_pid").select(F.col("pid").alias("a"), F.col("n_pid").alias("b"))
    return graph.exclusive_cliques(near).select("block_id", F.size("clique").alias("n"))


# Blocks


@query(
    sql("disks") + ", f AS (SELECT pid % 97 AS body, pid AS face, (pid * 37 % 90)::DOUBLE AS angle FROM disks), k AS (SELECT *, CASE WHEN angle < 30 THEN 'slide' WHEN angle < 60 THEN 'topple' ELSE 'fall' END AS kind FROM f), v AS (SELECT body, kind, count(*) AS n, min(face) AS first FROM k GROUP BY ALL)"
    " SELECT v.body, min(CASE WHEN g.under THEN 0 ELSE 1 END) = 1 AS stable, arg_max(kind, n * 1000000 - first) AS mode FROM v JOIN (SELECT body, bool_or(angle < 45) AS under FROM f GROUP BY body) g ON g.body = v.body GROUP BY v.body"
)
def agg_block_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability and failure mode of bodies by their faces' angles."""
    f = cloud(spark, sf_dir, "disks").select((F.col("pid") % 97).alias("body"), F.col("pid").alias("face"), (F.col("pid") * 37 % 90).cast("double").alias("angle"))
    return blocks.face_measures(f, "body")


@query()
def s_facet_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facet attributes as text."""
    from strataspark.sources.tables import facet_csv

    return facet_csv(facets.characterise(cloud(spark, sf_dir, "parts"), "grp").withColumnRenamed("grp", "facet")).select("facet", "n", "valid", "trace_length")


