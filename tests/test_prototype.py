"""Hemispheres, circles, prisms, sets, neighbours and spreads against numpy and brute force."""

import math

import numpy as np
import pytest

from strataspark.operators import cluster, facets, planes, prototype, spatial

XYZ = ("x", "y", "z")


def unit_rows(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_hemispheres_by_svd(spark):
    groups = {g: unit_rows(40, g) * [1, 1, 0.3 + g] for g in range(3)}
    rows = [(g, k, *map(float, v)) for g, vs in groups.items() for k, v in enumerate(vs)]
    got = {(r.grp, r.pid): np.array([r.x, r.y, r.z]) for r in prototype.to_hemisphere(spark.createDataFrame(rows, "grp int, pid int, x double, y double, z double"), ["grp"]).collect()}
    for g, vs in groups.items():
        ref = np.linalg.svd(vs, full_matrices=False)[2][0]
        ref = ref * np.sign(ref[np.argmax(np.abs(ref))])
        for k, v in enumerate(vs):
            assert got[g, k] == pytest.approx(v * (-1 if v @ ref < 0 else 1))
    zero = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], "grp int, pid int, x double, y double, z double")
    assert prototype.to_hemisphere(zero, ["grp"]).first()[:] == (0, 1, 0.0, 0.0, 0.0)


def test_point_scores(spark):
    p = np.random.default_rng(3).random((60, 3)) * [4, 4, 0.5]
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    rows, want = [], {}
    for i in range(60):
        near = [j for j in np.argsort(d[i]) if j != i][:8]
        rows += [(i, int(j), *map(float, p[j]), float(d[i, j])) for j in near]
        values = np.sort(np.linalg.eigvalsh(np.cov(p[near].T, bias=True)))
        want[i] = ((values[1] - values[0]) / values[2], 1 / (np.sqrt(d[i, near]).mean() + 1e-8))
    df = spark.createDataFrame(rows, "pid long, n_pid long, n_x double, n_y double, n_z double, d2 double")
    for r in prototype.point_scores(df).collect():
        assert (r.planarity, r.density, r.score) == pytest.approx((*want[r.pid], sum(want[r.pid])), rel=1e-6)
    line = spark.createDataFrame([(1, k, float(k), 0.0, 0.0, 1.0) for k in range(5)], df.schema)
    assert prototype.point_scores(line).first().planarity == 0


def test_circles(spark):
    rng = np.random.default_rng(5)
    turn = rng.uniform(0, 4, 80)
    exact = np.column_stack([3 + 2 * np.cos(turn), -1 + 2 * np.sin(turn)])
    noisy = exact + rng.normal(scale=0.1, size=exact.shape)
    rows = [("exact", *map(float, q)) for q in exact] + [("noisy", *map(float, q)) for q in noisy] + [("line", float(k), 2.0 * k) for k in range(6)]
    df = spark.createDataFrame(rows, "grp string, s double, t double")
    got = {r.grp: (r.cs, r.ct, r.radius) for r in prototype.circles(df, "grp").collect()}
    assert got["exact"] == pytest.approx((3, -1, 2)) and got["line"] == (None, None, None)
    a = np.column_stack([2 * noisy, np.ones(80)])
    c = np.linalg.lstsq(a, (noisy**2).sum(axis=1), rcond=None)[0]
    assert got["noisy"] == pytest.approx((c[0], c[1], math.sqrt(c[2] + c[0] ** 2 + c[1] ** 2)))
    fit = {r.grp: (r.cs, r.ct, r.radius) for r in prototype.geometric_circles(df.where("grp <> 'line'"), "grp").collect()}
    assert fit["exact"] == pytest.approx((3, -1, 2))
    cost = lambda s, t: np.hypot(noisy[:, 0] - s, noisy[:, 1] - t).var()
    s, t, radius = fit["noisy"]
    assert radius == pytest.approx(np.hypot(noisy[:, 0] - s, noisy[:, 1] - t).mean()) and cost(s, t) <= cost(*got["noisy"][:2])
    assert all(cost(s, t) <= cost(s + ds, t + dt) + 1e-12 for ds in (-1e-3, 0, 1e-3) for dt in (-1e-3, 0, 1e-3))


def test_common_prisms_hold_what_all_disks_hold(spark):
    rng = np.random.default_rng(8)
    disks = [(g, *map(float, rng.uniform(-1, 1, 2)), float(k), 3.0) for g in range(2) for k in range(25)] + [(2, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 0.0, 2.0, 1.0), (3, 1.0, 1.0, 7.0, 0.5), (4, None, 1.0, 7.0, 0.5)]
    got = {r.grp: r for r in prototype.common_prisms(spark.createDataFrame(disks, "grp int, x double, y double, z double, r double"), "grp", parts=4).collect()}
    assert got[2].s == [] and got[2].area == 0 and (got[0].n, got[0].low, got[0].high) == (25, 0.0, 24.0) and 4 not in got
    assert got[3].area == pytest.approx(32 * 0.25 * math.sin(2 * math.pi / 64)) and len(got[3].s) == 64
    for g in range(2):
        own = np.array([d[1:3] for d in disks if d[0] == g])
        ring = np.column_stack([got[g].s, got[g].t])
        edge = np.roll(ring, -1, axis=0) - ring
        for q in rng.uniform(-4, 4, (400, 2)):
            far = np.hypot(*(own - q).T).max()
            inside = bool((edge[:, 0] * (q[1] - ring[:, 1]) - edge[:, 1] * (q[0] - ring[:, 0]) >= 0).all())
            assert inside if far < 3 * math.cos(math.pi / 64) - 1e-9 else not inside or far <= 3


def fold(v, degrees):
    sets, number = np.full(len(v), -1), 0
    for i in range(len(v)):
        if sets[i] < 0:
            sets[i] = number
            for j in range(i + 1, len(v)):
                if math.degrees(math.acos(max(-1.0, min(1.0, float(v[i] @ v[j]))))) < degrees:
                    sets[j] = number
            number += 1
    return sets.tolist()


@pytest.mark.parametrize("degrees,at_once", [(30.0, 2000), (30.0, 3), (8.0, 7), (170.0, 1)])
def test_sets_in_order_equal_the_fold(spark, degrees, at_once):
    v = unit_rows(150, 11)
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)], "pid long, x double, y double, z double").repartition(3)
    got = [r.set for r in cluster.set_grouping(df, degrees, at_once=at_once).orderBy("pid").collect()]
    assert got == fold(v, degrees)
    assert cluster.set_grouping(df.limit(0), degrees).count() == 0


def test_neighbours_in_small_groups(spark):
    """Groups with fewer others than are asked for, far points, and none at all."""
    rng = np.random.default_rng(2)
    rows = [(k, k % 4 if k < 80 else 9, *map(float, rng.random(3) * 10)) for k in range(83)] + [(90, 1, 5000.0, 0.0, 0.0), (91, 7, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pid long, grp int, x double, y double, z double")
    for k, by in ((5, ("grp",)), (3, ("grp",)), (5, ()), (100, ())):
        got = sorted((r.pid, r["rank"], r.n_pid) for r in spatial.knn(df, df, k, 0.5, by=by).collect())
        want = []
        for p in rows:
            near = sorted((sum((a - b) ** 2 for a, b in zip(p[2:], q[2:], strict=True)), q[0]) for q in rows if not by or q[1] == p[1])
            want += [(p[0], n + 1, i) for n, (_, i) in enumerate(near[:k])]
        assert got == sorted(want)
    assert spatial.knn(df, df.limit(0), 3, 1.0).count() == 0
    other = df.where("grp = 9")
    assert {r.pid for r in spatial.knn(df, other, 2, 1.0, by=("grp",)).collect()} == {80, 81, 82}


def test_nearest_of_many_centers(spark):
    v, c = unit_rows(300, 4), unit_rows(60, 6)
    points = spark.createDataFrame([(k, "clash", *map(float, x)) for k, x in enumerate(np.vstack([v, v[:5]]))], "pid long, n_pid string, x double, y double, z double")
    centers = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(c)], "center_id long, x double, y double, z double")
    few = {r.pid: (r.center_id, r.cosine) for r in spatial.nearest_center(points, centers).collect()}
    many = {r.pid: (r.center_id, r.cosine) for r in spatial.nearest_center(points, centers, most_centers=10).collect()}
    assert len(few) == 305 and {k: x[0] for k, x in few.items()} == {k: x[0] for k, x in many.items()} and all(many[k][1] == pytest.approx(x[1]) for k, x in few.items())


def test_spread_in_two_steps_is_a_bound(spark):
    rng = np.random.default_rng(12)
    p, n = rng.random((120, 3)) * 3, unit_rows(120, 13)
    df = spark.createDataFrame([(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(p, n, strict=True))], "pid long, x double, y double, z double, nx double, ny double, nz double")
    exact = {r.pid: r for r in facets.boundary_by_normals(df, 0.8, 100.0, 4).collect()}
    near = {r.pid: r for r in facets.boundary_by_normals(df, 0.8, 100.0, 4, exact=False).collect()}
    told = {r.pid: r.boundary for r in facets.boundary_by_normals(df, 0.8, 100.0, 4, mark_all=True).collect()}
    held = set()
    for k in range(120):
        ball = np.flatnonzero(((p - p[k]) ** 2).sum(axis=1) <= 0.64)
        if len(ball) < 4:
            assert exact[k].spread is None and near[k].spread is None
            continue
        most = math.degrees(math.acos(max(-1.0, (n[ball] @ n[ball].T).min())))
        assert exact[k].spread == pytest.approx(most, abs=1e-5) and most / 2 - 1e-6 <= near[k].spread <= most + 1e-5
        if most >= 100:
            held |= set(ball.tolist())
    assert {k for k, b in told.items() if b} == held


def test_curvature_of_samples(spark):
    rows = [(1, k, float(k % 5), float(k // 5), 0.1 * (k % 3)) for k in range(25)] + [(2, k, 0.0, float(k), 0.0) for k in range(2)]
    df = spark.createDataFrame(rows, "pid long, n_pid long, n_x double, n_y double, n_z double")
    got = {r.pid: r for r in planes.neighbour_planes(df, least=3, default=(0, 0, 1)).collect()}
    assert (got[2].a, got[2].b, got[2].c, got[2].curvature) == (0, 0, 1, 0) and got[1].n == 25
    few = planes.neighbour_planes(df, cap=10).where("pid = 1").first()
    again = planes.neighbour_planes(df.repartition(5), cap=10).where("pid = 1").first()
    assert few.n == 10 and few.curvature == pytest.approx(again.curvature) and planes.neighbour_planes(df, cap=30).where("pid = 1").first().n == 25


def test_traces_miss_their_hulls(spark):
    """A level plane has no line in the ground, and a far one misses its hull."""
    flat = [("flat", k, float(k % 3), float(k // 3), 5.0) for k in range(9)]
    far = [("far", 100 + k, float(k % 3), float(k // 3), 100.0 + k % 3) for k in range(9)]
    hit = [("hit", 200 + k, float(k % 3), float(k // 3), float(k % 3) - 1) for k in range(9)]
    rows = spark.createDataFrame(flat + far + hit, "grp string, pid long, x double, y double, z double")
    got = {r.grp: r for r in prototype.xy_traces(rows, "grp").collect()}
    assert got["flat"].length is None and got["far"].length is None and got["far"].n == 9
    assert got["hit"].length == pytest.approx(2) and got["hit"].x1 == pytest.approx(1) and got["hit"].dip == pytest.approx(45)
