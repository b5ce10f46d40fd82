"""Analytic fixtures and brute force for the geometry in numpy and for operators that SQL cannot express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import hull
from strataspark.operators import cluster, graph, planes, synth
from strataspark.sources import files, tables


def test_hulls():
    rng = np.random.default_rng(1)
    p = rng.random((300, 2))
    ring = hull.hull2(p)
    a, b = p[ring], p[np.roll(ring, -1)]
    side = (b - a)[:, None, 0] * (p[None, :, 1] - a[:, None, 1]) - (b - a)[:, None, 1] * (p[None, :, 0] - a[:, None, 0])
    assert (side > -1e-12).all() and hull.area_centroid(p[ring])[0] > 0
    cube = np.array([(x, y, z) for x in (-1.0, 1) for y in (-1.0, 1) for z in (-1.0, 1)])
    faces = hull.hull3(np.vstack([cube, rng.uniform(-1, 1, (50, 3))]))
    assert hull.volume_area(np.vstack([cube, np.zeros((50, 3))]), faces) == pytest.approx((8, 24))
    q = rng.normal(size=(200, 3))
    for i, j, k in hull.hull3(q):
        m = np.cross(q[j] - q[i], q[k] - q[i])
        assert ((q - q[i]) @ m <= 1e-7).all()
    assert len(hull.hull3(np.column_stack([p, np.zeros(300)]))) == 0
    assert list(hull.hull2(np.array([[0.0, 0], [1, 1], [2, 2]]))) == [0, 2]


def test_delaunay_and_alpha():
    p = np.random.default_rng(2).random((80, 2))
    t = hull.delaunay(p)
    area = sum(hull.area_centroid(p[f])[0] for f in t)
    assert area == pytest.approx(hull.area_centroid(p[hull.hull2(p)])[0], rel=1e-6)
    for f in t:
        a, b, c = p[f]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), np.array([b @ b - a @ a, c @ c - a @ a]))
        assert (((p - m) ** 2).sum(axis=1) >= ((a - m) ** 2).sum() - 1e-9).all()
    s = np.linspace(0, 2 * np.pi, 200)
    r = np.where(np.arange(200) % 2, 0.5, 1.0)
    star = np.column_stack([r * np.cos(s), r * np.sin(s)])
    rings = hull.alpha_shape(np.vstack([star, star * 0.5, star * 0.2]), 2.0)
    assert abs(hull.area_centroid(np.vstack([star, star * 0.5, star * 0.2])[rings[0]])[0]) <= hull.area_centroid(star[hull.hull2(star)])[0] + 1e-9


def test_chebyshev():
    cube = np.array([(a, b, c, -1.0) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    center, radius = hull.chebyshev(cube)
    assert np.abs(center).max() < 0.05 and radius == pytest.approx(1, abs=0.05)


def test_plane_fit_recovers_patch(spark):
    p = synth.patch(spark, (1, 2, 3), (1, 2, 2), 2.0, 2.0, 0.1, sigma=0.01).withColumn("g", F.lit(0))
    r = planes.fit_planes(p, ["g"]).first()
    assert abs(abs(r.a + 2 * r.b + 2 * r.c) / 3 - 1) < 1e-4 and r.l1**0.5 == pytest.approx(0.01, rel=0.1)
    x = np.array(p.select("x", "y", "z").collect())
    assert r.l1 == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[0], rel=1e-4)
    line = spark.range(10).select(F.lit(0).alias("g"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert planes.fit_planes(line, ["g"]).first().a is None


def test_graphs(spark):
    cube = spark.range(8).select(F.col("id").alias("a"), F.explode(F.array(*[F.col("id").bitwiseXOR(F.lit(1 << k)) for k in range(3)])).alias("b"))
    assert graph.cycles(cube, 4).count() == 6
    pyramid = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)], "a long, b long")
    assert graph.triangles(pyramid).count() == 4
    assert sorted(sorted(r.clique) for r in graph.maximal_cliques(pyramid).collect()) == [[0, 1, 4], [0, 3, 4], [1, 2, 4], [2, 3, 4]]
    weighted = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 1.0)], "a long, b long, w double")
    assert sorted((r.a, r.b) for r in graph.spanning_forest(weighted).collect()) == [(0, 1), (1, 2), (3, 4)]
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(path).collect()} == {0}


def test_fold_directions():
    v = np.array([[1.0, 0, 0], [math.cos(0.05), math.sin(0.05), 0], [0, 1, 0], [math.cos(0.08), math.sin(0.08), 0]])
    centers, label = cluster.fold_directions(v, 5.0)
    assert label.tolist() == [0, 0, 1, 0] and np.allclose(np.linalg.norm(centers, axis=1), 1)


def test_ply_round_trip(spark, tmp_path):
    points = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"), F.lit(0.5).alias("z"), (F.col("id") % 2).cast("int").alias("label"))
    files.write_ply_binary(points, f"file://{tmp_path}/bin", "label", [("x", "double"), ("y", "double"), ("z", "float")]).collect()
    back = files.read_ply(spark, f"{tmp_path}/bin")
    assert sorted((r.x, r.y, r.z) for r in back.collect()) == [(float(i), 2.0 * i, 0.5) for i in range(50)]
    ordered = points.withColumn("at", F.col("x").cast("long"))
    files.write_ply_ascii(files.ply_lines(ordered, "at", [("x", "float"), ("y", "float"), ("z", "float")]), f"{tmp_path}/ascii")
    part = next((tmp_path / "ascii").glob("part-*"))
    part.rename(tmp_path / "cloud.ply")
    assert files.read_ply(spark, f"{tmp_path}/cloud.ply").count() == 50
    assert files.read_vertex(spark, f"{tmp_path}/cloud.ply", 7).first().y == 14


def test_las_and_text(spark, tmp_path):
    x = np.array([1.0, 2.5, 3.25])
    (tmp_path / "a.las").write_bytes(files.las_bytes(x, x * 2, x * 3))
    assert [r.y for r in files.read_las(spark, f"{tmp_path}/a.las").orderBy("vertex_index").collect()] == pytest.approx([2, 5, 6.5])
    (tmp_path / "a.xyz").write_text("1 2 3\n4,5,6 7\nbad line here\n")
    assert sorted((r.x, r.label) for r in files.read_xyz(spark, f"{tmp_path}/a.xyz").collect()) == [(1.0, None), (4.0, 7)]
    (tmp_path / "d.tsv").write_text("1\t2\t3\t5\t1\t0\t0\t1\t0\n1\t2\t3\t4\t-1\t0\t0\t1\t0\n1\t2\t3\t2\t1\t0\t0\t1\t0\n")
    assert [(r.js, r.cluster_id) for r in tables.read_dse(spark, f"{tmp_path}/d.tsv").orderBy("js").collect()] == [(2, 1), (4, None), (5, 0)]
