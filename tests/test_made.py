"""Clouds and bodies that are made of rows: what is drawn, what is extracted, and every query with SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import planes, ransac, synth
from strataspark.plans import clouds_made
from tests_common import against_duckdb

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["b7_half_space_corners", "b7_half_space_volume", "g10_closed_bodies", "g9_cube_cycles", "b3_corner_blocks", "b2_component_blocks", "b1_clique_blocks", "y1_patch", "y10_sweep"])
def test_against_duckdb(spark, name):
    against_duckdb(spark, name, SF)


def test_normal_numbers(spark):
    """Moments, tails and independence of the generator's numbers."""
    rows = spark.range(40_000).select(synth.gaussian(3, F.col("id")).alias("a"), synth.gaussian(4, F.col("id")).alias("b"), synth.uniform(3, F.col("id")).alias("u"))
    v = np.array(rows.collect())
    a, b, u = v.T
    assert abs(a.mean()) < 0.02 and abs(a.std() - 1) < 0.02 and abs((a**3).mean()) < 0.06 and abs((a**4).mean() - 3) < 0.15
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.02 and abs(np.corrcoef(a, u)[0, 1]) < 0.02
    assert abs((np.abs(a) > 1.96).mean() - 0.05) < 0.005 and np.abs(np.histogram(u, 20, (0, 1))[0] - 2000).max() < 200


def test_control_heights(spark):
    """Heights at control points are the drawn ones, and linear between; other patches have others."""
    spec = spark.range(2).select(F.col("id").alias("patch"), *[F.lit(v).alias(k) for k, v in {"cx": 0.0, "cy": 0.0, "cz": 0.0, "nx": 0.0, "ny": 0.0, "nz": 1.0, "half_u": 2.0, "half_v": 2.0, "step": 0.5, "sigma": 0.0, "bend_m": 0.0, "wave_m": 0.0}.items()], F.lit(4).alias("grid_k"), F.lit(0.3).alias("grid_m"))
    p = {(r.patch, round(r.y, 3), round(-r.x, 3)): r.z for r in synth.patches(spec).collect()}
    assert len(p) == 2 * 81 and all(abs(z) <= 0.3 for z in p.values()) and np.std(list(p.values())) > 0.05
    for u in np.arange(-2, 2, 1.0):
        assert p[0, u + 0.5, 1.0] == pytest.approx((p[0, u, 1.0] + p[0, u + 1, 1.0]) / 2)
    assert p[0, 0.0, 0.0] != p[1, 0.0, 0.0]


def test_corner_cases(spark):
    rows = spark.range(26_000).select((F.col("id") % 13).alias("case"), F.col("id").alias("pid"))
    c = synth.corners_of(rows)
    n = {(r.case, r.plane): r["count"] for r in c.groupBy("case", "plane").count().collect()}
    for case, shares in enumerate(synth.CORNER_CASES):
        whole = sum(n[case, k] for k in range(len(shares)))
        assert (case, len(shares)) not in n and abs(n[case, None] - 40) < 30 and whole + n[case, None] == 2000
        assert all(abs(n[case, k] / whole - s / sum(shares)) < 0.04 for k, s in enumerate(shares))
    for r in planes.fit_planes(c.where("plane IS NOT NULL"), ["case", "plane"]).collect():
        axis = "cab"[r.plane]
        assert abs(r[axis]) > math.cos(math.radians(10))
    box = c.agg(*[f(a) for a in "xyz" for f in (F.min, F.max)]).first()
    assert min(box) == 0 and max(box) == 10


def test_extract_by_groups(spark):
    """Groups end on their own; a sample draws the planes, all points count."""
    rng = np.random.default_rng(6)
    rows = []
    for g, n in ((0, 1), (1, 3)):
        for k in range(n):
            rows += [(g, len(rows) + i, float(x), float(y), 50.0 * k) for i, (x, y) in enumerate(rng.uniform(0, 10, (200 + 40 * k, 2)))]
    rows += [(2, 10_000 + i, *map(float, q)) for i, q in enumerate(rng.uniform(0, 10, (150, 3)))] + [(3, 20_000, 0.0, 0.0, 0.0)]
    cloud = spark.createDataFrame(rows, "grp int, pid long, x double, y double, z double")
    found = sorted((r.grp, r.place, r.inliers, r.left) for r in ransac.extract_all(cloud, 0.02, 200, share=0.2, stop=10, by=["grp"], sample=60).collect())
    assert found == [(0, 0, 200, 200), (1, 0, 280, 720), (1, 1, 240, 440), (1, 2, 200, 200)]
    assert ransac.extract_all(cloud.limit(0), 0.02, 10).count() == 0 and ransac.extract_all(cloud.where("grp = 3"), 0.02, 10).columns == ["place", "a", "b", "c", "d", "inliers", "left"]


def test_sampled_points_are_the_same_in_any_partitions(spark):
    cloud = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("pid"), *[F.col("id").cast("double").alias(a) for a in "xyz"])
    one = sorted(map(tuple, ransac.sampled(cloud.repartition(1), ["g"], 20, 5).collect()))
    assert one == sorted(map(tuple, ransac.sampled(cloud.repartition(7), ["g"], 20, 5).collect())) and len(one) == 40


def test_cases_are_within_the_known_range(spark):
    """As many planes as are on record for these cases, and as much of the cloud explained."""
    got = clouds_made.r4_extract(spark, SF).collect()
    assert len(got) == 13 and all(1 <= r.planes <= 9 and r.explained > 0.4 for r in got)
    faces = clouds_made.y12_icosahedron(spark, SF).collect()
    assert len(faces) == 20 and all(abs(r.rms - 0.02) < 0.006 for r in faces)
