"""Tables and files of points: layouts with and without headers, results, NPZ, sets, and small graphs of facets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_common import against_duckdb

from strataspark.functions.vec import vec
from strataspark.operators import cluster, facets, graph, synth
from strataspark.sources import files, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g7_segment_graph", "v12_disk_axes", "g2_tree_edges", "g3_maximal_cliques"])
def test_against_duckdb(spark, name):
    against_duckdb(spark, name, SF)


def test_qfacet_file(spark, tmp_path):
    rows = ["X\tY\tZ\tcluster_id\tsubcluster_id\tfacet_id\tA\tB\tC\tD\tmore"]
    rows += ["1\t2\t3\t0\t5\t7\t0\t0\t1\t-3\tq", "1.5\tbad\t3\t0\t4\tx\t0\t0\t1\tnan\tq", "0\t0\t0\t-1\t-1\t9\t1\t0\t0\t0\tq", "0\t0\t0\t-1\t-1\t-1\t1\t0\t0\t0\tq", "0\t0\t1\t0\t5\t7\t0\t0\t1\t-3\tq"]
    (tmp_path / "cloud.tsv").write_text("\n".join(rows) + "\n")
    got = [tuple(r) for r in tables.read_qfacet(spark, f"file://{tmp_path}/cloud.tsv").select("x", "y", "cluster_id", "subcluster_id", "facet_id", "combined_id").collect()]
    assert sorted(got, key=repr) == sorted([(1.0, 2.0, 0, 5, 7, 0), (1.5, None, 0, 4, -1, 1), (0.0, 0.0, -1, 0, 9, 9), (0.0, 0.0, -1, -1, -1, None), (0.0, 0.0, 0, 5, 7, 0)], key=repr)
    (tmp_path / "short.tsv").write_text("X\tY\n1\t2\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_qfacet(spark, f"file://{tmp_path}/short.tsv")


def test_facet_lines_and_csv_files(spark, tmp_path):
    points = spark.range(50).select(F.col("id"), *[(F.col("id") / 3).alias(a) for a in "xyz"], F.lit(1).alias("cluster_id"), F.lit(None).cast("int").alias("subcluster_id"), F.col("id").cast("int").alias("facet_id"), *[F.when(F.col("id") % 2 == 0, 0.5).alias(a) for a in "abcd"], F.lit(0.25).alias("curvature"))
    tables.write_facets_tsv(points, f"file://{tmp_path}/tsv", "id")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/tsv").collect()]
    assert len(lines) == 50 and "0.333333333\t0.333333333\t0.333333333\t1\t-1\t1\tnan\tnan\tnan\tnan\t0.250000000" in lines
    facet = spark.range(3).select(F.col("id").alias("facet"), F.lit(4).alias("n"), F.struct(F.lit(1.0).alias("x")).alias("center"))
    tables.write_facet_csv(facet, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/csv")
    assert back.columns == list(tables.FACET_COLUMNS) and back.first().center == '{"x":1.0}' and back.first().area is None


def test_results_are_appended(spark, tmp_path):
    schema = "file string, backend string, n_points long, threshold_m double, inliers long, inlier_ratio double, plane_a double, plane_b double, plane_c double, plane_d double, runtime_ms double"
    for k in range(2):
        tables.append_results(spark.createDataFrame([(f"Plane1_Gno{k}.ply", "spark", 10, 0.02, 5, 0.5, 0.0, 0.0, 1.0, -1.0, 3.5)], schema), f"file://{tmp_path}/results")
    assert [r.file for r in tables.read_results(spark, f"file://{tmp_path}/results").orderBy("file").collect()] == ["Plane1_Gno0.ply", "Plane1_Gno1.ply"]


def test_npz_and_sets(spark, tmp_path):
    n = 20
    np.savez(tmp_path / "a.npz", coords=np.arange(3 * n).reshape(n, 3) / 2, colors=np.full((n, 3), 7, dtype=np.uint8), ids=np.arange(4 * n).reshape(n, 4) % 3, planes=np.ones((n, 4)))
    cloud = files.read_npz(spark, f"file://{tmp_path}/a.npz")
    first = cloud.where("x = 0").first()
    assert cloud.count() == n and (first.y, first.red, first.point_id, first.joint_id, first.d) == (0.5, 7, 0, 1, 1.0)
    tables.split_by_set(cloud, f"file://{tmp_path}/sets", "joint_id")
    assert sorted(f.name for f in (tmp_path / "sets").iterdir() if f.is_dir()) == ["joint_id=0", "joint_id=1", "joint_id=2"] and spark.read.parquet(f"file://{tmp_path}/sets").count() == n


def test_cycle_bases(spark):
    """As many rings as edges beyond a spanning forest, each a cycle of the facet's own edges."""
    rng = random.Random(2)
    edges = {g: {tuple(sorted(rng.sample(range(12), 2))) for _ in range(20)} for g in range(3)}
    df = spark.createDataFrame([(g, a, b) for g, e in edges.items() for a, b in e], "g int, a long, b long")
    rings = {}
    for r in graph.cycle_bases(df, "g").collect():
        rings.setdefault(r.g, []).append(r.ring)
    for g, e in edges.items():
        parts = graph.components(df.where(F.col("g") == g).select("a", "b")).select("component").distinct().count()
        nodes = {v for pair in e for v in pair}
        assert len(rings[g]) == len(e) - len(nodes) + parts
        for ring in rings[g]:
            steps = [tuple(sorted(p)) for p in zip(ring, ring[1:] + ring[:1], strict=True)]
            assert len(set(ring)) == len(ring) >= 3 and set(steps) <= e


def test_regions_of_a_folded_sheet(spark):
    """Two flat sheets that meet at a steep edge are two regions; a gentle slope is one."""
    rows = [(g, 100 * g + 10 * i + j, float(i), float(j), max(0.0, i - 4) * slope) for g, slope in ((0, 3.0), (1, 0.05)) for i in range(9) for j in range(5)]
    t = facets.tin(spark.createDataFrame(rows, "grp int, pid long, x double, y double, z double"), "grp").withColumn("face", F.xxhash64("grp", "p0", "p1", "p2"))
    beside = graph.face_adjacency(t.select("face", F.array("p0", "p1", "p2").alias("ids"))).select("a", "b")
    got = cluster.grow_regions(t.select("face", "x", "y", "z"), beside).join(t.select("face", "grp"), "face").groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("region").alias("regions")).collect()
    assert {r.grp: (r.n, r.regions) for r in got} == {0: (64, 2), 1: (64, 1)}


def test_clean_cloud(spark):
    rng = np.random.default_rng(1)
    p = np.column_stack([rng.uniform(0, 1, 800), rng.uniform(0, 1, 800), rng.normal(scale=0.001, size=800)])
    rows = [(k, *map(float, q)) for k, q in enumerate(p)] + [(9000, 5.0, 5.0, 5.0), (9001, 0.5, 0.5, 2.0)]
    got = facets.clean_cloud(spark.createDataFrame(rows, "pid long, x double, y double, z double"), voxel=0.05, k=12, radius=0.12, least=8).collect()
    assert 200 < len(got) <= 420 and max(abs(r.z) for r in got) < 0.01 and all(r.nz > 0.95 for r in got)


def test_patch_planes_and_circle_disks(spark):
    a, b, c, d = synth.plane_of_patch((1, 2, 3), (0, 3, 4))
    assert (a, b, c) == pytest.approx((0, 0.6, 0.8)) and d == pytest.approx(-3.6)
    row = spark.range(1).select(facets.circle_disk(F.lit(5.0)).alias("r"), vec(1, 2, 2).norm().alias("n")).first()
    assert (row.r, row.n) == (2.5, 3.0)
