"""Defined cases of the look-up operators."""

import pytest

from strataspark.operators import lookup


def test_empty_cloud_is_an_error(spark):
    cloud = spark.createDataFrame([(1, 0.5)], "pid long, x double")
    assert lookup.not_empty(cloud, "c").count() == 1
    with pytest.raises(ValueError, match="nothing.ply"):
        lookup.not_empty(cloud.where("pid = 2"), "nothing.ply")


def test_split_keeps_points_without_curvature(spark):
    points = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, None), (4, 0.2)], "pid long, curvature double")
    edge, rest = lookup.curvature_split(points, 0.2)
    assert [r.pid for r in edge.collect()] == [2] and sorted(r.pid for r in rest.collect()) == [1, 3, 4]


def test_clusters_number_by_first_place_and_leave_noise(spark):
    rows = [(0, 2, 5, 1.0), (1, 1, -1, 9.0), (2, 1, 1, 2.0), (3, 2, 5, 3.0), (4, 1, None, 4.0)]
    points = spark.createDataFrame([(i, js, cl, a, 0.0, 0.0, 0.0) for i, js, cl, a in rows], "at long, js int, cl int, a double, b double, c double, d double")
    got = {(r.js, r.cl): (r.cluster_id, r.n, r.a) for r in lookup.clusters(points, "at").collect()}
    assert got == {(2, 5): (0, 2, 1.0), (1, 1): (1, 1, 2.0)}


def test_seeds_break_ties_by_key(spark):
    polygons = spark.createDataFrame([("g", 3, 2.0), ("g", 1, 2.0), ("g", 2, None), ("h", 9, 1.0)], "grp string, pid long, area double")
    got = {r.pid: r.seed for r in lookup.seeds(polygons, "grp", "pid", "area").collect()}
    assert got == {1: 1, 3: 2, 2: 3, 9: 1}


def test_large_clusters_drop_noise(spark):
    labels = spark.createDataFrame([(i, 7) for i in range(3)] + [(9, 8)] + [(i, None) for i in range(20, 26)], "pid long, cluster long")
    assert sorted(r.pid for r in lookup.large_clusters(labels, "cluster", 2).collect()) == [0, 1, 2]
