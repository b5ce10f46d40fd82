"""Balls, near rows, hulls and greatest balls by cells and few steps, against plain loops and closed forms."""

import random

import numpy as np

from strataspark.functions import hull
from strataspark.operators import pairs, spatial


def _cloud(spark, n=250):
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(5)), rng.randrange(40) / 10, rng.choice((0.0, 1.0, 2.5))) for i in range(n)] + [(900, 70.0, 0.0, 0.0), (901, None, 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "pid long, x double, y double, z double")


def _d2(p, q):
    return sum((a - b) * (a - b) for a, b in zip(p, q, strict=True))


def test_moments_of_balls(spark):
    rows, points = _cloud(spark)
    held = np.array([r[1:] for r in rows if None not in r])
    got = {(r.x, r.y, r.z): r for r in spatial.ball_moments(points, 1.5).collect()}
    assert sum(r.weight for r in got.values()) == len(held)
    for p in map(tuple, held):
        ball = np.array([q for q in held if _d2(p, q) <= 2.25])
        r, cov = got[p], np.cov(ball.T, bias=True)
        assert r.n == len(ball) and np.allclose([r.mx, r.my, r.mz], ball.mean(axis=0))
        assert np.allclose([r.cxx, r.cxy, r.cxz, r.cyy, r.cyz, r.czz], cov[np.triu_indices(3)], atol=1e-12)


def test_moments_join_no_place_of_whole_cells(spark):
    """Many places within a few cells: what is made are rows of cells, and no row a pair of places."""
    points = spark.range(3000).selectExpr("id AS pid", "id % 1000 / 10000D AS x", "0D AS y", "id % 3 * 0.001D AS z")
    r = spatial.ball_moments(points, 2.0).groupBy("n").count().collect()
    assert [(v["n"], v["count"]) for v in r] == [(3000, 3000)]


def test_near_other(spark):
    rows, points = _cloud(spark)
    want = {j for j, *q in rows if j % 10 and None not in q and any(i % 10 == 0 and _d2(p, q) <= 0.25 for i, *p in rows)}
    assert {r["pid"] for r in pairs.near_other(points.where("pid % 10 = 0"), points.where("pid % 10 <> 0"), 0.5).collect()} == want


def test_adjacent_owners_of_near_centers(spark):
    rows, points = _cloud(spark, 60)
    points = points.withColumn("grp", points.pid % 7)
    centers = points.groupBy("grp").avg("x", "y", "z").toDF("grp", "x", "y", "z")
    at = {r["grp"]: (r.x, r.y, r.z) for r in centers.collect()}
    want = {(a, b) for a in at for b in at if a < b and _d2(at[a], at[b]) <= 1.0 and any(i % 7 == a and j % 7 == b and None not in p and None not in q and _d2(p, q) <= 0.09 for i, *p in rows for j, *q in rows)}
    assert want and {(r.a, r.b) for r in spatial.adjacent_owners_of_near_centers(points, centers, "grp", 0.3, 1.0).collect()} == want


def test_greatest_ball_is_exact():
    """A wedge, whose greatest ball touches four planes, and a slab, which has many."""
    wedge = np.array([[-1, 0, 0, 0], [0, -1, 0, 0], [0, 0, -1, 0], [1, 2, 3, -60]], dtype=float)
    center, radius = hull.chebyshev(wedge)
    assert np.allclose(center, 60 / (6 + 14**0.5), atol=1e-9) and abs(radius - 60 / (6 + 14**0.5)) < 1e-9
    box = np.array([[s * (k == a) for k in range(3)] + [-h] for a, h in enumerate((1.0, 5.0, 9.0)) for s in (-1, 1)], dtype=float)
    center, radius = hull.chebyshev(box)
    assert abs(radius - 1) < 1e-9 and (np.abs(center) <= (1e-9, 4 + 1e-9, 8 + 1e-9)).all()
    assert hull.chebyshev(np.array([[1.0, 0, 0, 1], [-1, 0, 0, 1], [0, 1, 0, -1], [0, -1, 0, -1], [0, 0, 1, -1], [0, 0, -1, -1]]))[1] < 0


def test_hull_has_corners_only():
    """Points within faces and edges of a box are no corners of its hull, in any order."""
    g = np.array([[x, y, z] for x in range(5) for y in range(5) for z in range(5) if {x, y, z} & {0, 4}]) * [0.37, 1.11, 0.93] + [800.0, 3.0, 1.5]
    for seed in range(3):
        p = np.random.default_rng(seed).permutation(g)
        f = hull.hull3(p)
        assert len(f) == 12 and len(np.unique(f)) == 8
        assert np.allclose(hull.volume_area(p, f)[0], 64 * 0.37 * 1.11 * 0.93)


def test_triangles_are_put_aside(monkeypatch):
    """Of a long strip of points, a point is compared with the triangles near it, not with all."""
    rng = np.random.default_rng(2)
    p = np.column_stack([np.sort(rng.random(1500)) * 400, rng.random(1500)])
    for f in hull.delaunay(p)[::50]:  # no point in the circle around three
        a, b, c = p[f]
        lhs = 2 * np.array([b - a, c - a])
        center = np.linalg.solve(lhs, [b @ b - a @ a, c @ c - a @ a])
        assert (np.linalg.norm(p - center, axis=1) >= np.linalg.norm(a - center) * (1 - 1e-6)).all()
    seen, whole = [], np.concatenate
    monkeypatch.setattr(np, "concatenate", lambda parts, **k: seen.append(max(map(len, parts))) or whole(parts, **k))
    hull.delaunay(p)
    assert np.median(seen) < 300


def test_disks_reach_no_further_than_they_are(spark, monkeypatch):
    """An extension of the balls makes no more candidates: two crossing disks, and one that others' planes miss."""
    from pyspark.sql import functions as F

    xyz = lambda *v: F.struct(*[F.col(c).cast("double").alias(a) for c, a in zip(v, "xyz", strict=True)])
    rows = [(1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0), (2, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 0, 1.5, 0, 0, 1, 1, 0, 0, 0, 1, 0)]
    d = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{i} double" for i in range(13)))
    disks = d.select(F.col("c0").cast("long").alias("id"), xyz("c1", "c2", "c3").alias("center"), xyz("c4", "c5", "c6").alias("n"), xyz("c7", "c8", "c9").alias("u"), xyz("c10", "c11", "c12").alias("v"), F.lit(1.0).alias("ra"), F.lit(1.0).alias("rb"))
    made, of = [], pairs.ball_pairs
    monkeypatch.setattr(pairs, "ball_pairs", lambda balls, key, most: made.append(most) or of(balls, key, most))
    got = [(r.a, r.b, round(r.length, 6)) for r in pairs.disk_segments(disks, 1.0, 3.0).collect()]
    assert got == [(1, 2, 2.0)] and made[0] < 1.01


def test_disks_go_with_their_balls(spark):
    """No join follows the one of the balls, and steps of the formula are no tables: candidates are neither shuffled nor written."""
    from pyspark.sql import functions as F

    xyz = lambda *v: F.struct(*[F.lit(float(c)).alias(a) for c, a in zip(v, "xyz", strict=True)])
    at = F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    flat, up = [(0, 0, 1), (1, 0, 0), (0, 1, 0)], [(0, 1, 0), (1, 0, 0), (0, 0, -1)]
    turn = lambda k: F.when(F.col("id") % 2 == 0, xyz(*flat[k])).otherwise(xyz(*up[k]))
    disks = spark.range(6).select("id", at.alias("center"), *[turn(k).alias(c) for k, c in enumerate("nuv")], F.lit(0.8).alias("ra"), F.lit(0.8).alias("rb"))
    told = pairs.disk_segments(disks, 1.0)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "parquet" not in plan
    assert sorted((r.a, r.b, round(r.length, 6)) for r in told.collect()) == [(i, i + 1, 0.6) for i in range(5)]
