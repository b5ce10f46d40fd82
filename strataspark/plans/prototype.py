"""Queries over hemispheres, point scores, fitted circles, traces in XY and sets in order, with the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.vec import vec
from strataspark.operators import cluster, facets, prototype, spatial
from strataspark.operators.graph import cut_lineage
from strataspark.plans.clouds import NORMALS_SQL, cloud, normals, sql
from strataspark.plans.geometry import _HULL
from strataspark.plans.spatial import _EIG, _KNN, _MOM, d2
from strataspark.plans.vectors import r

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(
    "WITH " + NORMALS_SQL + ", h AS (SELECT grp AS g, avg(x * x) AS xx, avg(x * y) AS xy, avg(x * z) AS xz, avg(y * y) AS yy, avg(y * z) AS yz, avg(z * z) AS zz FROM nrm GROUP BY grp), m AS (SELECT g, yy + zz AS cxx, -xy AS cxy, -xz AS cxz, xx + zz AS cyy, -yz AS cyz, xx + yy AS czz FROM h)"
    + _EIG + ", s AS (SELECT g, vx, vy, vz, CASE WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN sign(vx) WHEN abs(vy) >= abs(vz) THEN sign(vy) ELSE sign(vz) END AS s FROM u), t AS (SELECT n.pid, n.x, n.y, n.z, CASE WHEN s * (vx * n.x + vy * n.y + vz * n.z) < 0 THEN -1 ELSE 1 END AS f FROM nrm n JOIN s ON s.g = n.grp)"
    " SELECT pid, round(f * x, 6) + 0.0 AS x, round(f * y, 6) + 0.0 AS y, round(f * z, 6) + 0.0 AS z FROM t"
)
def v7_hemisphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals turned to the side of their group's main direction."""
    turned = prototype.to_hemisphere(normals(spark, sf_dir), ["grp"])
    return turned.select("pid", *[r(F.col(a), a) for a in "xyz"])


@query(
    sql("parts") + _KNN + "9), w AS (SELECT k.pid, sqrt(k.d2) AS far, q.x, q.y, q.z FROM k JOIN parts q ON q.pid = k.n_pid WHERE k.n_pid <> k.pid)" + _MOM.format(by="pid", src="w") + _EIG
    + ", a AS (SELECT pid, 1 / (avg(far) + 1e-8) AS density FROM w GROUP BY pid), z AS (SELECT g, l1, l3, (cxx + cyy + czz) - l1 - l3 AS l2 FROM u), y AS (SELECT g, CASE WHEN l2 > 1e-12 * l3 THEN (l2 - l1) / l3 ELSE 0 END AS planarity FROM z)"
    " SELECT pid, round(planarity, 4) + 0.0 AS planarity, round(density, 5) + 0.0 AS density, round(planarity + density, 4) + 0.0 AS score FROM a JOIN y ON y.g = a.pid"
)
def agg16_point_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planarity and density of the eight nearest other points."""
    p = cloud(spark, sf_dir, "parts").select("pid", "x", "y", "z")
    near = cut_lineage(spatial.knn(p, p, 9, 2.0)).where("pid <> n_pid").join(p.select(F.col("pid").alias("n_pid"), *[F.col(a).alias(f"n_{a}") for a in "xyz"]), "n_pid")
    return prototype.point_scores(near).select("pid", r(F.col("planarity"), "planarity", 4), r(F.col("density"), "density", 5), r(F.col("score"), "score", 4))


@query(
    sql("parts") + ", a AS (SELECT grp, avg(x) AS ms, avg(y) AS mt FROM parts GROUP BY grp), w AS (SELECT p.grp, ms, mt, x - ms AS s, y - mt AS t FROM parts p JOIN a ON a.grp = p.grp), m AS (SELECT grp, any_value(ms) AS ms, any_value(mt) AS mt, avg(s * s) AS ss, avg(s * t) AS st, avg(t * t) AS tt, avg(s * (s * s + t * t)) AS sz, avg(t * (s * s + t * t)) AS tz FROM w GROUP BY grp),"
    " c AS (SELECT *, (sz * tt - tz * st) / (2 * (ss * tt - st * st)) AS u, (tz * ss - sz * st) / (2 * (ss * tt - st * st)) AS v FROM m)"
    " SELECT grp, round(ms + u, 4) + 0.0 AS cs, round(mt + v, 4) + 0.0 AS ct, round(sqrt(u * u + v * v + ss + tt), 4) + 0.0 AS radius FROM c"
)
def k7_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circle of least squares through each group."""
    flat = cloud(spark, sf_dir, "parts").select("grp", F.col("x").alias("s"), F.col("y").alias("t"))
    return prototype.circles(flat, "grp").select("grp", r(F.col("cs"), "cs", 4), r(F.col("ct"), "ct", 4), r(F.col("radius"), "radius", 4))


_TRACE = (
    sql("parts") + _HULL.replace(" h AS ", " hl AS ") + _MOM.format(by="grp", src="parts") + _EIG
    + ", s AS (SELECT *, CASE WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN sign(vx) WHEN abs(vy) >= abs(vz) THEN sign(vy) ELSE sign(vz) END / vn AS f FROM u), pl AS (SELECT g, n, f * vx AS a, f * vy AS b, f * vz AS c, -f * (vx * mx + vy * my + vz * mz) AS d FROM s),"
    " ln AS (SELECT *, -d * a / (a * a + b * b) AS px, -d * b / (a * a + b * b) AS py, -b / sqrt(a * a + b * b) AS dx, a / sqrt(a * a + b * b) AS dy FROM pl),"
    " w1 AS (SELECT ln.*, (hl.s2 - hl.s) * (py - hl.t) - (hl.t2 - hl.t) * (px - hl.s) AS w, (hl.s2 - hl.s) * dy - (hl.t2 - hl.t) * dx AS v FROM ln JOIN hl ON hl.grp = ln.g),"
    " cut AS (SELECT g, max(-w / v) FILTER (v > 0) AS low, min(-w / v) FILTER (v < 0) AS high FROM w1 GROUP BY g)"
    " SELECT ln.g AS grp, n, round(degrees(acos(least(1, abs(c)))), 3) + 0.0 AS dip, round((degrees(atan2(b, a)) + 360) % 360, 3) + 0.0 AS dip_direction, CASE WHEN high - low > 1e-12 THEN round(px + dx * low, 3) + 0.0 END AS x1, CASE WHEN high - low > 1e-12 THEN round(py + dy * high, 3) + 0.0 END AS y2, CASE WHEN high - low > 1e-12 THEN round(high - low, 3) + 0.0 END AS length FROM ln JOIN cut ON cut.g = ln.g"
)


@query(_TRACE)
def k11_set_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets with the lines where their planes meet the ground, inside their hulls."""
    t = prototype.xy_traces(cloud(spark, sf_dir, "parts"), "grp")
    return t.select("grp", "n", r(F.col("dip"), "dip", 3), r(F.col("dip_direction"), "dip_direction", 3), r(F.col("x1"), "x1", 3), r(F.col("y2"), "y2", 3), r(F.col("length"), "length", 3))


_SETS = (
    "WITH RECURSIVE " + NORMALS_SQL + ", f AS (SELECT [min(pid)] AS ids, [arg_min(struct_pack(x := x, y := y, z := z), pid)] AS vs FROM nrm UNION ALL"
    " SELECT list_append(f.ids, q.pid), list_append(f.vs, q.v) FROM f, (SELECT min(n.pid) AS pid, arg_min(struct_pack(x := n.x, y := n.y, z := n.z), n.pid) AS v FROM nrm n, f WHERE n.pid > f.ids[-1] AND len(list_filter(f.vs, lambda c: degrees(acos(greatest(-1, least(1, c.x * n.x + c.y * n.y + c.z * n.z)))) < 30)) = 0) q WHERE q.pid IS NOT NULL),"
    " g AS (SELECT unnest(ids) AS founder, unnest(vs) AS v, generate_subscripts(ids, 1) - 1 AS number FROM f WHERE len(ids) = (SELECT max(len(ids)) FROM f))"
    " SELECT n.pid, max(g.number)::BIGINT AS set FROM nrm n JOIN g ON g.founder = n.pid OR (g.founder < n.pid AND degrees(acos(greatest(-1, least(1, g.v.x * n.x + g.v.y * n.y + g.v.z * n.z)))) < 30) GROUP BY n.pid"
)


@query(_SETS)
def c9_set_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of directions that facets found in order, a label for each."""
    return cluster.set_grouping(normals(spark, sf_dir), 30.0).select("pid", "set")


_BALL = ", j AS (SELECT p.pid, q.pid AS n_pid, q.nx, q.ny, q.nz FROM b p JOIN b q ON " + d2() + " <= 9)"
_CLOUD = sql("disks") + ", b AS (SELECT pid, x, y, z, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz FROM disks)"


def _with_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cloud(spark, sf_dir, "disks")
    n = vec("a", "b", "c")
    return d.select("pid", "x", "y", "z", *[(c / n.norm()).alias(f"n{k}") for k, c in zip("xyz", n.parts(), strict=True)])


@query(
    _CLOUD + _BALL + ", c AS (SELECT pid, count(*) AS m FROM j GROUP BY pid HAVING count(*) >= 2), a1 AS (SELECT j.pid, arg_min(struct_pack(x := nx, y := ny, z := nz), n_pid) AS n FROM j GROUP BY j.pid), a2 AS (SELECT pid, n FROM (SELECT j.pid, struct_pack(x := nx, y := ny, z := nz) AS n, row_number() OVER (PARTITION BY j.pid ORDER BY nx * n.x + ny * n.y + nz * n.z, n_pid) AS k FROM j JOIN a1 ON a1.pid = j.pid) WHERE k = 1),"
    " a3 AS (SELECT j.pid, min(nx * n.x + ny * n.y + nz * n.z) AS low FROM j JOIN a2 ON a2.pid = j.pid GROUP BY j.pid)"
    " SELECT a3.pid, CASE WHEN c.m IS NOT NULL THEN round(degrees(acos(greatest(-1, least(1, low)))), 3) + 0.0 END AS spread, c.m IS NOT NULL AND degrees(acos(greatest(-1, least(1, low)))) >= 60 AS boundary FROM a3 LEFT JOIN c ON c.pid = a3.pid"
)
def agg17_spread_farthest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle between two far normals of each ball, found in two steps."""
    got = facets.boundary_by_normals(_with_normals(spark, sf_dir), 3.0, 60.0, 2, exact=False)
    return got.select("pid", r(F.col("spread"), "spread", 3), "boundary")


@query(
    _CLOUD + _BALL + ", c AS (SELECT pid FROM j GROUP BY pid HAVING count(*) >= 2), w AS (SELECT p.pid FROM j p JOIN j q ON q.pid = p.pid JOIN c ON c.pid = p.pid GROUP BY p.pid HAVING degrees(acos(greatest(-1, least(1, min(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz))))) >= 60) SELECT DISTINCT n_pid AS pid FROM j JOIN w ON w.pid = j.pid"
)
def agg17_boundary_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of balls whose normals spread enough."""
    return facets.boundary_by_normals(_with_normals(spark, sf_dir), 3.0, 60.0, 2, mark_all=True).where("boundary").select("pid")


@query()
def k11_common_prisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prisms that the disks of each group share; the tests hold their polygons to points inside and outside."""
    d = cloud(spark, sf_dir, "disks").select("grp", "x", "y", "z", (F.lit(80.0) + F.col("ra")).alias("r"))
    return prototype.common_prisms(d, "grp").select("grp", "n", "low", "high", F.size("s").alias("corners"), r(F.col("area"), "area", 3))
