"""Every query of the library with SQL against DuckDB, at the smallest scale."""

import os

import pytest
from tests_common import against_duckdb

from strataspark.plans.registry import ORACLES

SF = "/root/testdata/sf0.001"
QUICK = ("agg_plane_fits", "v_three_planes", "v_polygons", "f_filters", "a_heat_map", "a_quantile_bands", "s_qfacet", "j1_knn", "j2_radius", "j4_ball_pairs", "t2_sliding_tiles", "c6_dbscan", "k2_hull_polygons", "r1_best_planes", "g5_triangles", "v7_hemisphere", "k7_circles", "k11_set_traces", "c9_set_labels", "agg16_point_scores", "agg17_spread_farthest_twice", "agg17_boundary_of_all", "j12_clusters", "f2_curvature_split", "t4_seeds", "f12_pruned_nodes", "c8_large_clusters")


@pytest.mark.parametrize("name", QUICK if not os.environ.get("ALL_QUERIES") else sorted(ORACLES))
def test_against_duckdb(spark, name):
    against_duckdb(spark, name, SF)
