"""Files in ranges, files of bodies, and tiles: round trips, odd files, and every query over them against DuckDB."""

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import outlines
from strataspark.plans.exports import ORACLES, QUERIES
from strataspark.sources import bodies, files
from strataspark.sources.formats import PIECE, register

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "customer", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    shown = lambda it: sorted((tuple(map(plain, r)) for r in it), key=repr)
    assert shown(got.select(*columns).collect()) == shown(want.fetchall())


def ply(path, n, order="little", before=b"", head=()):
    dtype = np.dtype([("x", "f8"), ("y", "f8"), ("z", "f4"), ("red", "u1"), ("id", "u4")]).newbyteorder("<" if order == "little" else ">")
    rows = np.zeros(n, dtype=dtype)
    for c, values in (("x", np.arange(n)), ("y", -np.arange(n)), ("z", np.arange(n) / 4), ("red", np.arange(n) % 256), ("id", 3_000_000_000 + np.arange(n))):
        rows[c] = values
    lines = ["ply", f"format binary_{order}_endian 1.0", "comment made by a test", *head, f"element vertex {n}", "property double x", "property double y", "property float z", "property uchar red", "property uint id", "end_header", ""]
    path.write_bytes("\n".join(lines).encode() + before + rows.tobytes())


@pytest.mark.parametrize("order", ["little", "big"])
def test_ranges_make_the_same_table(spark, tmp_path, order):
    ply(tmp_path / "a.ply", 5000, order)
    ply(tmp_path / "b.PLY", 1, order)
    ply(tmp_path / "none.ply", 0, order)
    (tmp_path / "note.txt").write_text("not a cloud")
    whole = files.read_ply(spark, str(tmp_path))
    want = rows_of(whole)
    assert len(want) == 5001 and want[0][1:] in {(0, 0.0, 0.0, 0.0, 0, 3_000_000_000)}
    size = (tmp_path / "a.ply").stat().st_size
    for split in (997, 25 * 100, size // 3 + 1, size - 1):
        parts = files.read_ply(spark, f"file://{tmp_path}", split_bytes=split)
        assert [r[1:] for r in rows_of(parts)] == [r[1:] for r in want]
        assert parts.rdd.getNumPartitions() == sum(-(-max((tmp_path / f).stat().st_size, 1) // split) for f in ("a.ply", "b.PLY", "none.ply"))
    some = files.read_ply(spark, f"{tmp_path}/a.ply", ["z", "id"], split_bytes=4000)
    assert some.columns == ["z", "id"] and rows_of(some) == sorted(((r[4], r[6]) for r in want if r[0].endswith("a.ply")), key=repr)
    assert files.read_vertex(spark, f"{tmp_path}/a.ply", 4321).select("vertex_index", "x", "id").collect() == [(4321, 4321.0, 3_000_004_321)]
    assert files.read_vertex(spark, f"{tmp_path}/a.ply", 5000).count() == 0


def test_pieces_of_a_large_file(spark, tmp_path):
    n = 2 * PIECE + 17
    ply(tmp_path / "large.ply", n)
    r = files.read_ply(spark, f"{tmp_path}/large.ply", ["vertex_index", "x", "red"]).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.max("vertex_index").alias("last"), F.count_distinct("vertex_index").alias("ids")).first()
    assert (r.n, r.x, r["last"], r.ids) == (n, n * (n - 1) / 2, n - 1, n)


def test_other_elements(spark, tmp_path):
    """Fixed elements and lists before the vertices, and list elements themselves."""
    camera = struct.pack("<2f", 1.5, 2.5)
    ply(tmp_path / "camera.ply", 100, before=camera, head=("element camera 1", "property float f", "property float g"))
    assert files.read_ply(spark, f"{tmp_path}/camera.ply", ["x"], split_bytes=300).agg(F.sum("x")).first()[0] == 4950
    assert [tuple(r)[1:] for r in files.read_ply(spark, f"{tmp_path}/camera.ply", element="camera").collect()] == [(0, 1.5, 2.5)]
    lists = b"".join(struct.pack(f"<B{n}i", n, *range(n)) for n in (3, 0, 5))
    ply(tmp_path / "lists.ply", 100, before=lists, head=("element face 3", "property list uchar int vertex_indices"))
    assert files.read_ply(spark, f"{tmp_path}/lists.ply", ["x"], split_bytes=300).agg(F.sum("x"), F.count("*")).first()[:] == (4950, 100)
    assert [r.vertex_indices for r in files.read_ply(spark, f"{tmp_path}/lists.ply", element="face", split_bytes=50).orderBy("face_index").collect()] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]


def test_ascii_and_errors(spark, tmp_path):
    head = "ply\nformat ascii 1.0\nelement face 1\nproperty list uchar int ids\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
    (tmp_path / "a.ply").write_text(head + "3 0 1 1\n1 2 3 4\n5 6 7.5 8\n")
    assert rows_of(files.read_ply(spark, f"{tmp_path}/a.ply", ["vertex_index", "z", "red"], split_bytes=20)) == [(0, 3.0, 4), (1, 7.5, 8)]
    assert files.read_ply(spark, f"{tmp_path}/a.ply", element="face").first().ids == [0, 1, 1]
    (tmp_path / "short.ply").write_text(head + "3 0 1 1\n1 2 3 4\n")
    with pytest.raises(Exception, match="ends before"):
        files.read_ply(spark, f"{tmp_path}/short.ply").collect()
    ply(tmp_path / "cut.ply", 1000)
    data = (tmp_path / "cut.ply").read_bytes()
    (tmp_path / "cut.ply").write_bytes(data[: len(data) // 2])
    for split in (1 << 20, 500):
        with pytest.raises(Exception, match="ends before"):
            files.read_ply(spark, f"{tmp_path}/cut.ply", split_bytes=split).collect()
    (tmp_path / "text.ply").write_text("no header")
    with pytest.raises(Exception, match="not a PLY file"):
        files.read_ply(spark, f"{tmp_path}/text.ply").collect()
    (tmp_path / "flat.ply").write_text("ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nend_header\n")
    with pytest.raises(Exception, match="no vertices"):
        files.read_ply(spark, f"{tmp_path}/flat.ply").collect()
    with pytest.raises(Exception, match="no such column"):
        files.read_ply(spark, f"{tmp_path}/a.ply", ["blue"]).collect()


def test_las_in_ranges(spark, tmp_path):
    n = 3000
    x = np.arange(n) * 0.25
    (tmp_path / "a.las").write_bytes(files.las_bytes(x, x * 2, -x, np.stack([np.arange(n) % 256] * 3, axis=1)))
    register(spark)
    want = rows_of(files.read_las(spark, f"{tmp_path}/a.las", ["vertex_index", "x", "y", "z", "red"]))
    assert len(want) == n and want[1] == (1, 0.25, 0.5, pytest.approx(-0.25), 256)
    for split in (1000, 34 * 50, 40_000):
        assert rows_of(files.read_las(spark, f"file://{tmp_path}", ["vertex_index", "x", "y", "z", "red"], split_bytes=split)) == want
    data = bytearray((tmp_path / "a.las").read_bytes())
    data[104] |= 0x80
    (tmp_path / "z.las").write_bytes(data)
    with pytest.raises(Exception, match="compressed"):
        files.read_las(spark, f"{tmp_path}/z.las").collect()


def test_offsets_are_prefix_sums(spark):
    rows = [(k * 37 % 1009, k % 11) for k in range(1000)]
    for parts in (1, 5, 40):
        got = {r.key: r.offset for r in bodies.offsets(spark.createDataFrame(rows, "key long, n long"), "key", "n", parts).collect()}
        total = 0
        for key, n in sorted(rows):
            assert got[key] == total
            total += n


@pytest.mark.parametrize("binary", [True, False])
@pytest.mark.parametrize("most", [None, 7, 100])
def test_bodies_round_trip(spark, tmp_path, binary, most):
    shapes = {k: [(float(k), float(i), k * i / 8) for i in range(k % 6)] for k in range(30)}
    table = spark.createDataFrame([(k, [dict(zip("xyz", p, strict=True)) for p in pts]) for k, pts in shapes.items()], "k long, p array<struct<x: double, y: double, z: double>>")
    written = bodies.write_bodies(outlines.polygons(table, F.col("k"), "p"), f"file://{tmp_path}", most_vertices=most, binary=binary).collect()
    total = sum(map(len, shapes.values()))
    assert sum(w.n_vertices for w in written) == total and (most is not None or len(written) == 1) and sorted(w.file for w in written) == sorted(f.stem for f in tmp_path.glob("*.ply"))
    assert not [f for f in tmp_path.iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
    v = {(r.file, r.vertex_index): (r.x, r.y, r.z) for r in bodies.read_bodies(spark, str(tmp_path)).collect()}
    assert sorted(v.values()) == sorted(p for pts in shapes.values() for p in pts)
    edges = sorted(tuple(sorted((v[r.file, r.vertex1], v[r.file, r.vertex2]))) for r in bodies.read_bodies(spark, str(tmp_path), "edge").collect())
    assert edges == sorted(tuple(sorted((pts[i], pts[(i + 1) % len(pts)]))) for pts in shapes.values() if len(pts) > 1 for i in range(len(pts) if len(pts) > 2 else 1))
    faces = sorted([v[r.file, i] for i in r.vertex_indices] for r in bodies.read_bodies(spark, str(tmp_path), "face").collect())
    assert faces == sorted(pts for pts in shapes.values() if len(pts) > 2)
    again = bodies.write_bodies(outlines.polygons(table, F.col("k"), "p"), f"file://{tmp_path}", most_vertices=most, binary=binary)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, written))


def test_faces_of_many_corners_are_fans(spark, tmp_path):
    table = spark.range(1).select(F.lit(0).alias("k"), F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.struct(F.cos(i / 300 * 6.28).alias("x"), F.sin(i / 300 * 6.28).alias("y"), F.lit(0.0).alias("z"))).alias("p"))
    made = outlines.polygons(table, F.col("k"), "p")
    assert made.faces.count() == 298 and made.edges.count() == 300
    bodies.write_bodies(made, f"file://{tmp_path}")
    assert bodies.read_bodies(spark, str(tmp_path), "face").where(F.size("vertex_indices") == 3).count() == 298


def test_tiles_of_nothing_and_of_one_point(spark, tmp_path):
    points = spark.createDataFrame([(7, 1.0, 2.0, 3.0, 9)], "pid long, x double, y double, z double, label int")
    index = bodies.write_tiles(points.where("pid < 0"), f"file://{tmp_path}/none", 5.0)
    assert index.count() == 0
    index = bodies.write_tiles(points, f"file://{tmp_path}/one", 5.0, fields=[("label", "int")]).collect()
    assert len(index) == 1 and index[0].tile_id == "x0_y0_z0" and index[0].n_in_file == 1 and index[0].save_path.endswith("/one/tiles/x0_y0_z0.ply")
    assert bodies.read_bodies(spark, f"{tmp_path}/one/tiles").first().label == 9


def test_a_hot_tile_has_several_files(spark, tmp_path):
    points = spark.range(2000).select(F.col("id").alias("pid"), F.lit(1.0).alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.when(F.col("id") % 10 == 0, 50.0).otherwise(0.0).alias("z"))
    index = bodies.write_tiles(points, f"file://{tmp_path}", 10.0, least=100, most_points=300).collect()
    big = [r for r in index if r.n_points == 1800]
    assert len(index) == 7 and len(big) == 6 and sum(r.n_in_file for r in big) == 1800
    assert bodies.read_bodies(spark, f"{tmp_path}/tiles").count() == 2000


def test_cubes_with_their_directions(spark, tmp_path):
    """Cubes of one, two and three directions are told apart; the manifest, the files' names and colours agree."""
    rng = np.random.default_rng(3)
    axes = {0: [(0, 0, 1)], 1: [(0, 0, 1), (1, 0, 0)], 2: [(0, 0, 1), (1, 0, 0), (0, 1, 0)]}
    rows = []
    for cube, directions in axes.items():
        for k in range(120):
            n = np.array(directions[k % len(directions)]) + rng.normal(scale=0.03, size=3)
            rows.append((len(rows), *map(float, rng.uniform(0.5, 9.5, 3) + [10 * cube, 0, 0]), *map(float, n * rng.choice([-1, 1]) * 2)))
    rows += [(1000, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1001, 29.9, 9.9, 9.9, 0.0, 0.0, 1.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double")
    got = sorted(bodies.write_cubes(points, f"file://{tmp_path}", "cloud", 10.0, least=50, inits=3, rounds=4).collect(), key=lambda r: r.ix)
    assert [(r.ix, r.iy, r.iz, r.best_k, r.is_clustered) for r in got] == [(0, 0, 0, 1, True), (1, 0, 0, 2, True), (2, 0, 0, 3, True)]
    assert [len(r.proportions.split(";")) for r in got] == [1, 2, 3] and all(abs(float(p) - 1 / r.best_k) < 0.01 for r in got for p in r.proportions.split(";"))
    assert got[0].pair_angles_deg in (None, "") and all(abs(float(a) - 90) < 3 for r in got[1:] for a in r.pair_angles_deg.split(";"))
    assert got[1].cube_file.endswith("/cubes/cloud_Cube_x1_y0_z0_X10_Y0_Z0_S10_T10_N120_K2.ply") and got[0].score_kind == "dispersion" and got[2].score_kind == "silhouette"
    held = {r.file[:14]: r for r in bodies.read_bodies(spark, f"{tmp_path}/cubes").groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("red", "green", "blue").alias("colours")).collect()}
    assert [(held[f"cloud_Cube_x{k}_"].n, held[f"cloud_Cube_x{k}_"].colours) for k in range(3)] == [(121, 1), (120, 2), (121, 3)]


def test_las_npz_and_xyz_clouds(spark, tmp_path):
    points = spark.range(700).select(F.col("id").alias("pid"), F.concat(F.lit("cloud"), (F.col("id") % 3 == 0).cast("int").cast("string")).alias("grp"), (F.col("id") / 8).alias("x"), (-F.col("id") / 4).alias("y"), F.lit(1.5).alias("z"), *[(F.col("id") % 256).cast("int").alias(c) for c in ("red", "green", "blue")], F.col("id").cast("int").alias("point_id"), (F.col("id") % 5).cast("int").alias("joint_id"), F.when(F.col("id") % 2 == 0, 0.5).alias("a"))
    for most, many in ((1_000_000, 2), (100, 8)):
        written = bodies.write_clouds(points, f"file://{tmp_path}/las{most}", "grp", "las", most).collect()
        assert len(written) == many and sum(r.n_in_file for r in written) == 700
        back = files.read_las(spark, f"{tmp_path}/las{most}", ["x", "y", "z", "red"], split_bytes=500)
        want = sorted((k / 8, -k / 4, 1.5, k % 256 * 256) for k in range(700))
        got = sorted(map(tuple, back.collect()))
        assert all(g == pytest.approx(w, abs=6e-4) for g, w in zip(got, want, strict=True))
    bodies.write_clouds(points, f"file://{tmp_path}/npz", "grp", "npz")
    back = files.read_npz(spark, f"file://{tmp_path}/npz/*.npz")
    row = back.where("point_id = 8").first()
    assert back.count() == 700 and (row.x, row.y, row.joint_id, row.cluster_id, row.red, row.a) == (1.0, -2.0, 3, -1, 8, 0.5) and math.isnan(row.d)
    bodies.write_xyz(points, f"file://{tmp_path}/xyz", "pid", "joint_id")
    text = files.read_xyz(spark, f"file://{tmp_path}/xyz")
    assert text.count() == 700 and text.where("x = 1.0").first()[:] == (1.0, -2.0, 1.5, 3)
