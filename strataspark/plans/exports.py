"""Queries that write files and read them back, with what they should hold for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import vec as V
from strataspark.functions.vec import vec
from strataspark.operators import facets, outlines
from strataspark.operators.graph import _shared_top, cut_lineage
from strataspark.plans.clouds import cloud, sql
from strataspark.plans.geometry import _HULL, _flat
from strataspark.plans.vectors import _DET, r
from strataspark.sources import bodies, files

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{_shared_top(spark)}/files-{uuid.uuid4().hex}"


@query(sql("parts") + " SELECT grp, pid, x, y, z FROM parts")
def src1_ply_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PLY file for each group, read back in ranges of 700 bytes, which cut through records."""
    folder = _folder(spark)
    p = cloud(spark, sf_dir, "parts").withColumn("pid", F.col("pid").cast("int"))
    names = cut_lineage(files.write_ply_binary(p, folder, "grp", [("x", "double"), ("y", "double"), ("z", "double"), ("pid", "int")]))
    back = files.read_ply(spark, folder, ["path", "pid", "x", "y", "z"], split_bytes=700)
    file = F.substring_index("path", "/", -1).alias("file")
    return back.select(file, "pid", "x", "y", "z").join(names.select("grp", file), "file").select("grp", F.col("pid").cast("long").alias("pid"), "x", "y", "z")


_TILES = ", l AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts), t AS (SELECT floor((x - lx) / 7)::BIGINT AS i, floor((y - ly) / 7)::BIGINT AS j, floor((z - lz) / 7)::BIGINT AS k, * FROM pts, l), m AS (SELECT i, j, k, count(*)::BIGINT AS n_points, any_value(lx) + i * 7 AS origin_x, min(x) AS min_x, max(y) AS max_y, sum(x) AS sx, sum(z) AS sz FROM t GROUP BY i, j, k HAVING count(*) >= 20)"


@query(sql("pts") + _TILES + " SELECT 'x' || i || '_y' || j || '_z' || k AS tile_id, i, j, k, n_points, round(origin_x, 5) + 0.0 AS origin_x, min_x, max_y, n_points AS n_read, round(sx, 4) + 0.0 AS sum_x, round(sz, 3) + 0.0 AS sum_z, ceil(n_points / 300)::BIGINT AS n_files FROM m")
def snk19_tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes as files with their index; tiles of more than 300 points have several. What the files hold stands beside
    what the index says."""
    folder = _folder(spark)
    index = bodies.write_tiles(cloud(spark, sf_dir, "pts"), folder, 7.0, 0.0, 20, 300)
    held = bodies.read_bodies(spark, f"{folder}/tiles").groupBy("file").agg(F.count("*").alias("n_read"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z"))
    sums = held.groupBy(F.regexp_replace("file", "_part[0-9]+$", "").alias("tile_id")).agg(*[F.sum(c).alias(c) for c in ("n_read", "sum_x", "sum_z")])
    named = index.groupBy("tile_id").agg(*[F.first(c).alias(c) for c in ("i", "j", "k", "n_points", "origin_x", "min_x", "max_y")], F.count("*").alias("files"), F.sum("n_in_file").alias("in_files"))
    # as many files as their limit asks for, less those that a hash has left empty
    told = F.when((F.col("files") <= F.ceil(F.col("n_points") / 300)) & (F.col("in_files") == F.col("n_points")), F.ceil(F.col("n_points") / 300)).alias("n_files")
    return named.join(sums, "tile_id").select("tile_id", "i", "j", "k", "n_points", r(F.col("origin_x"), "origin_x", 5), "min_x", "max_y", "n_read", r(F.col("sum_x"), "sum_x", 4), r(F.col("sum_z"), "sum_z", 3), told)


_CUBES = (
    ", l AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM disks), w AS (SELECT unnest(range(0, 9)) AS i), c AS (SELECT a.i AS ix, b.i AS iy, c.i AS iz, lx + a.i * 25 AS x0, ly + b.i * 25 AS y0, lz + c.i * 25 AS z0 FROM l, w a, w b, w c WHERE lx + a.i * 25 < hx AND ly + b.i * 25 < hy AND lz + c.i * 25 < hz)"
    " SELECT ix::BIGINT AS ix, iy::BIGINT AS iy, iz::BIGINT AS iz, round(x0, 3) + 0.0 AS x0, count(*)::BIGINT AS n_points, count(*)::BIGINT AS n_read, round(sum(x), 3) + 0.0 AS sum_x FROM disks JOIN c ON x >= x0 AND x < x0 + 50 AND y >= y0 AND y < y0 + 50 AND z >= z0 AND z < z0 + 50 GROUP BY ix, iy, iz, x0 HAVING count(*) >= 10"
)


@query(sql("disks") + _CUBES)
def t3_cube_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping cubes with the directions of their normals, as files with a manifest, and what the files hold."""
    folder = _folder(spark)
    n = vec("a", "b", "c")
    d = cloud(spark, sf_dir, "disks").select("pid", "x", "y", "z", *[(c / n.norm()).alias(f"n{k}") for k, c in zip("xyz", n.parts(), strict=True)])
    manifest = bodies.write_cubes(d, folder, "disks", 50.0, 25.0, 10, most_points=200, inits=2, rounds=3)
    held = bodies.read_bodies(spark, f"{folder}/cubes").groupBy("file").agg(F.count("*").alias("n_read"), F.sum("x").alias("sum_x"))
    rows = manifest.withColumn("file", F.regexp_extract("cube_file", r"([^/]*)\.ply$", 1)).join(held, "file")
    return rows.groupBy("ix", "iy", "iz", r(F.col("x0"), "x0", 3), "n_points").agg(F.sum("n_read").alias("n_read"), r(F.sum("sum_x"), "sum_x", 3))


def _flat_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir, "disks").select("pid", "grp", vec("x", "y", "z").struct().alias("center"), vec(1, 0, 0).struct().alias("u"), vec(0, 1, 0).struct().alias("v"), F.col("ra").alias("a"), F.col("rb").alias("b"))


_FILES = ", o AS (SELECT *, (row_number() OVER (ORDER BY pid) - 1) * 13 AS before FROM disks), f AS (SELECT *, before // 4000 AS file, before - min(before) OVER (PARTITION BY before // 4000) AS shift FROM o)"


@query(sql("disks") + _FILES + ", v AS (SELECT unnest(range(0, 13)) AS vid) SELECT 'part-' || file AS file, (shift + vid)::BIGINT AS vertex_index, round(x + CASE WHEN vid > 0 THEN ra * cos((vid - 1) * (2 * pi() / 12)) ELSE 0 END, 5) + 0.0 AS x, round(y + CASE WHEN vid > 0 THEN rb * sin((vid - 1) * (2 * pi() / 12)) ELSE 0 END, 5) + 0.0 AS y FROM f, v")
def snk9_merged_disk_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks merged into files of some 4,000 vertices: the vertices by their places."""
    folder = _folder(spark)
    bodies.write_bodies(outlines.disks(_flat_disks(spark, sf_dir), "pid", 12), folder, most_vertices=4000)
    return bodies.read_bodies(spark, folder).select("file", "vertex_index", r(F.col("x"), "x", 5), r(F.col("y"), "y", 5))


@query(sql("disks") + _FILES + ", v AS (SELECT unnest(range(1, 13)) AS j) SELECT 'part-' || file AS file, (row_number() OVER (PARTITION BY file ORDER BY shift, j) - 1)::BIGINT AS face_index, shift::BIGINT AS i, (shift + j)::BIGINT AS j, (shift + j % 12 + 1)::BIGINT AS k FROM f, v")
def snk9_merged_disk_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same: the triangles, whose corners are shifted by the vertices before."""
    folder = _folder(spark)
    bodies.write_bodies(outlines.disks(_flat_disks(spark, sf_dir), "pid", 12), folder, most_vertices=4000)
    faces = bodies.read_bodies(spark, folder, "face")
    return faces.select("file", "face_index", *[F.col("vertex_indices")[k].cast("long").alias(c) for k, c in enumerate("ijk")])


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """file, and the ends of every edge, as read back."""
    v = bodies.read_bodies(spark, folder)
    e = bodies.read_bodies(spark, folder, "edge")
    end = lambda k: v.select("file", F.col("vertex_index").alias(f"vertex{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
    return e.join(end(1), ["file", "vertex1"]).join(end(2), ["file", "vertex2"])


@query(sql("parts") + _HULL + " SELECT s AS x1, t AS y1, s2 AS x2, t2 AS y2 FROM h")
def snk9_merged_polygon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of facets merged into files: the edges, from corner to corner."""
    folder = _folder(spark)
    p = facets.hull_polygons(_flat(spark, sf_dir), "grp").withColumn("p", F.transform(F.arrays_zip("s", "t"), lambda e: F.struct(e["s"].alias("x"), e["t"].alias("y"), F.lit(0.0).alias("z"))))
    bodies.write_bodies(outlines.polygons(cut_lineage(p), F.col("grp"), "p"), folder, most_vertices=30)
    return _edges(spark, folder).select("x1", "y1", "x2", "y2")


@query(sql("disks") + " SELECT 'grp' || grp AS file, count(*) * 6 AS n_edges, count(*) * 6 AS n_vertices, (6 * sum(CASE WHEN pid % 3 = 0 THEN 255 WHEN pid % 3 = 1 THEN 0 ELSE 128 END))::BIGINT AS red, round(sum(3 * (x + x)), 3) + 0.0 AS sum_x FROM disks GROUP BY grp")
def snk10_block_wireframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each block with the outlines of its facets in the colours of their kinds."""
    folder = _folder(spark)
    d = _flat_disks(spark, sf_dir).withColumn("p", outlines.ring_points("center", "u", "v", "a", "b", 6)).withColumn("kind", F.element_at(F.array(F.lit("joint"), F.lit("shell"), F.lit("none")), (F.col("pid") % 3 + 1).cast("int")))
    frames = outlines.wireframes(cut_lineage(d), "grp", "pid", "p", "kind", {"joint": (255, 0, 0), "shell": (0, 255, 0)})
    written = bodies.write_bodies(frames, folder, file=F.concat(F.lit("grp"), F.col("body.block").cast("string")))
    held = bodies.read_bodies(spark, folder).groupBy("file").agg(F.count("*").alias("n_vertices"), F.sum(F.col("red").cast("long")).alias("red"), r(F.sum("x"), "sum_x", 3))
    return held.join(_edges(spark, folder).groupBy("file").agg(F.count("*").alias("n_edges")), "file").join(written.select("file"), "file").select("file", "n_edges", "n_vertices", "red", "sum_x")


@query(
    sql("planes") + ", t AS (SELECT p.pid, p.a a1, p.b b1, p.c c1, p.d d1, q.a a2, q.b b2, q.c c2, q.d d2, s.a a3, s.b b3, s.c c3, s.d d3 FROM planes p JOIN planes q ON q.pid = p.pid + 1 JOIN planes s ON s.pid = p.pid + 2),"
    f" m AS (SELECT *, {_DET} AS det FROM t) SELECT 'corner_' || pid || '_' || (pid + 1) || '_' || (pid + 2) AS file, 0::BIGINT AS vertex_index, round(-(d1 * (b2 * c3 - c2 * b3) + d2 * (b3 * c1 - c3 * b1) + d3 * (b1 * c2 - c1 * b2)) / det, 4) + 0.0 AS x, round(-(d1 * (a2 * b3 - b2 * a3) + d2 * (a3 * b1 - b3 * a1) + d3 * (a1 * b2 - b1 * a2)) / det, 4) + 0.0 AS z FROM m WHERE abs(det) >= 1e-3"
)
def snk18_corner_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner of each three planes in a file that is named after them."""
    p = cloud(spark, sf_dir, "planes")
    side = lambda k: p.select((F.col("pid") - k + 1).alias("pid"), *[F.col(c).alias(f"{c}{k}") for c in "abcd"])
    x = V.three_planes(*[e for k in (1, 2, 3) for e in (vec(f"a{k}", f"b{k}", f"c{k}"), F.col(f"d{k}"))], eps=1e-3)
    rows = side(1).join(side(2), "pid").join(side(3), "pid").select(F.col("pid").alias("i"), (F.col("pid") + 1).alias("j"), (F.col("pid") + 2).alias("k"), *[c.alias(a) for c, a in zip(x.parts(), "xyz", strict=True)]).where("x IS NOT NULL")
    folder = _folder(spark)
    ids = [F.col(f"body.{c}").cast("string") for c in "ijk"]
    bodies.write_bodies(outlines.corners(cut_lineage(rows), ("i", "j", "k")), folder, file=F.concat_ws("_", F.lit("corner"), *ids))
    return bodies.read_bodies(spark, folder).select("file", "vertex_index", r(F.col("x"), "x", 4), r(F.col("z"), "z", 4))


@query(sql("disks") + " SELECT round(x, 4) + 0.0 AS x1, round(y, 4) + 0.0 AS y1, round(x + 2 * a, 4) + 0.0 AS x2, round(y + 2 * b, 4) + 0.0 AS y2, round(z + 2 * c, 4) + 0.0 AS z2 FROM disks")
def snk23_whiskers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals as lines of an ascii file."""
    folder = _folder(spark)
    bodies.write_bodies(outlines.whiskers(cloud(spark, sf_dir, "disks"), F.col("pid"), ("a", "b", "c"), 2.0), folder, most_vertices=1000, binary=False)
    return _edges(spark, folder).select(*[r(F.col(c), c, 4) for c in ("x1", "y1", "x2", "y2", "z2")])
