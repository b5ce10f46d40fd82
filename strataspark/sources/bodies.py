"""Files of bodies: PLY files with vertices, edges and faces, and the tiles of clouds.

A body is a facet's outline, a trace, a disk, a segment, a block: vertices numbered from 0 within the body, and edges and
faces that name them by these numbers. Bodies are written as many to a file as fit, or each to a file of its own, and
the numbers are shifted by the vertices that stand before in the file. The shifts are prefix sums over the bodies in
order of their keys, taken in two levels: within ranges of keys, and over the ranges.

A file's lines meet in one task, sorted, and are written as they come. How much that is, is bounded by the size of a
file, so that a table of any size is written by as many tasks as it has files. A file gets its name when it is whole; a
task that is taken again writes it again.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.operators.graph import cut_lineage
from strataspark.operators.spatial import XYZ, tile_points
from strataspark.sources.files import las_bytes
from strataspark.sources.formats import PLY_TYPES, file_system, register

COLOURS = ("red", "green", "blue")


@dataclass
class Bodies:
    """vertices: (body, vid, x, y, z, maybe red, green, blue); edges: (body, i, j); faces: (body, ids). body is of any
    type that sorts; edges and faces are in order of their columns."""

    vertices: DataFrame
    edges: DataFrame | None = None
    faces: DataFrame | None = None


def offsets(sizes: DataFrame, key: str, count: str, parts: int | None = None) -> DataFrame:
    """sizes (key unique, count, more) with `offset`, the sum of count over all lesser keys: summed within the
    partitions of a range sort, and over the partitions, of which there are `parts`."""
    spark = sizes.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(sizes.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_part").agg(F.sum(count).alias("_sum"))
    before = whole.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    own = ranged.withColumn("_own", F.coalesce(F.sum(count).over(within), F.lit(0)))
    return own.join(F.broadcast(before.drop("_sum")), "_part").withColumn("offset", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def _sizes(bodies: Bodies) -> DataFrame:
    """body, n_vertices, n_edges, n_faces."""
    tables = [("n_vertices", bodies.vertices), ("n_edges", bodies.edges), ("n_faces", bodies.faces)]
    each = [t.groupBy("body").agg(*[(F.count("*") if n == name else F.lit(0)).cast("long").alias(n) for n, _ in tables]) for name, t in tables if t is not None]
    total = each[0]
    for one in each[1:]:
        total = total.unionByName(one)
    return total.groupBy("body").agg(*[F.sum(n).alias(n) for n, _ in tables])


def planned(bodies: Bodies, file: Column | None = None, most_vertices: int | None = None) -> DataFrame:
    """body, file, offset (vertices before it in the file), n_vertices, n_edges, n_faces.

    file: a name for each body, of an expression over body. Without it, bodies go to files 'part-<k>' in order, a new
    file where the number of vertices before passes a multiple of most_vertices, or to the one file 'part-0'."""
    sizes = _sizes(bodies)
    if file is not None:
        named = sizes.withColumn("file", file)
        within = Window.partitionBy("file").orderBy("body").rowsBetween(Window.unboundedPreceding, -1)
        return named.withColumn("offset", F.coalesce(F.sum("n_vertices").over(within), F.lit(0)))
    placed = offsets(sizes, "body", "n_vertices")
    number = F.floor(F.col("offset") / most_vertices) if most_vertices else F.lit(0)
    placed = cut_lineage(placed.withColumn("file", F.concat(F.lit("part-"), number.cast("string"))))
    first = placed.groupBy("file").agg(F.min("offset").alias("_first"))
    return placed.join(first, "file").withColumn("offset", F.col("offset") - F.col("_first")).drop("_first")


@dataclass
class _Open:
    """A file that is being written."""

    folder: str
    name: str
    counts: tuple[int, int, int]
    properties: list[tuple[str, str]]
    has: tuple[bool, bool]
    binary: bool
    written: list[int] = field(default_factory=lambda: [0, 0, 0])

    def __post_init__(self) -> None:
        self.fs, top, _ = file_system(self.folder)
        self.fs.create_dir(top, recursive=True)
        self.path, self.part = f"{top}/{self.name}.ply", f"{top}/.{self.name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        head = ["ply", f"format {'binary_little_endian' if self.binary else 'ascii'} 1.0", f"element vertex {self.counts[0]}", *[f"property {t} {p}" for p, t in self.properties]]
        if self.has[0]:
            head += [f"element edge {self.counts[1]}", "property int vertex1", "property int vertex2"]
        if self.has[1]:
            head += [f"element face {self.counts[2]}", "property list uchar int vertex_indices"]
        self.out.write("\n".join([*head, "end_header", ""]).encode())

    def vertices(self, columns: dict[str, np.ndarray]) -> None:
        n = len(columns["x"])
        self.written[0] += n
        if self.binary:
            rows = np.empty(n, dtype=[(p, "<" + PLY_TYPES[t][0]) for p, t in self.properties])
            for p, _ in self.properties:
                rows[p] = columns[p]
            self.out.write(rows.tobytes())
        else:
            shown = [[f"{v:.6f}" for v in columns[p].tolist()] if t in ("float", "double") else [str(int(v)) for v in columns[p].tolist()] for p, t in self.properties]
            self.out.write("".join(" ".join(row) + "\n" for row in zip(*shown, strict=True)).encode())

    def lists(self, element: int, rows: list[list[int]]) -> None:
        self.written[element] += len(rows)
        if not self.binary:
            self.out.write("".join((f"{len(r)} " if element == 2 else "") + " ".join(map(str, r)) + "\n" for r in rows).encode())
        elif element == 1:
            self.out.write(np.array(rows, dtype="<i4").tobytes())
        else:
            if any(len(r) > 255 for r in rows):
                raise ValueError("a face of a PLY file has 255 corners at most")
            self.out.write(b"".join(bytes([len(r)]) + np.array(r, dtype="<i4").tobytes() for r in rows))

    def close(self) -> None:
        self.out.close()
        if tuple(self.written) != self.counts:
            raise ValueError(f"{self.name}: {self.written} rows came for {self.counts}")
        self.fs.move(self.part, self.path)


def write_bodies(bodies: Bodies, folder: str, file: Column | None = None, most_vertices: int | None = None, binary: bool = True, coordinate: str = "double") -> DataFrame:
    """file, path, n_vertices, n_edges, n_faces: PLY files below folder. file and most_vertices as of planned().
    The files are written when the result is computed; it is a table, so that happens once."""
    plan = cut_lineage(planned(bodies, file, most_vertices))
    colours = [c for c in COLOURS if c in bodies.vertices.columns]
    properties = [*[(a, coordinate) for a in XYZ], *[(c, "uchar") for c in colours]]
    has = (bodies.edges is not None, bodies.faces is not None)
    place = plan.select("body", "file", "offset")
    empty = F.lit(None).cast("array<long>").alias("ids")
    none = [F.lit(None).cast("double").alias(p) for p, _ in properties]
    head = plan.groupBy("file").agg(*[F.sum(n).alias(n) for n in ("n_vertices", "n_edges", "n_faces")]).select("file", F.lit(0).alias("element"), F.lit(None).cast("array<long>").alias("at"), *none, F.array("n_vertices", "n_edges", "n_faces").alias("ids"))
    moved = lambda c: F.col(c) + F.col("offset")
    rows = head.unionByName(bodies.vertices.join(place, "body").select("file", F.lit(1).alias("element"), F.array(moved("vid")).alias("at"), *[F.col(p).cast("double").alias(p) for p, _ in properties], empty))
    if bodies.edges is not None:
        ends = F.array(moved("i"), moved("j"))
        rows = rows.unionByName(bodies.edges.join(place, "body").select("file", F.lit(2).alias("element"), F.concat(F.array(F.col("offset")), ends).alias("at"), *none, ends.alias("ids")))
    if bodies.faces is not None:
        corners = F.transform("ids", lambda i: i.cast("long") + F.col("offset"))
        rows = rows.unionByName(bodies.faces.join(place, "body").select("file", F.lit(3).alias("element"), F.concat(F.array(F.col("offset")), corners).alias("at"), *none, corners.alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Open | None = None
        done = []

        def finish() -> None:
            if now is not None:
                now.close()
                done.append((now.name, now.path, *now.counts))

        for batch in batches:
            names, elements = batch.column("file").to_pylist(), batch.column("element").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at] and elements[end] == elements[at]:
                    end += 1
                part = batch.slice(at, end - at)
                if elements[at] == 0:
                    finish()
                    now = _Open(folder, names[at], tuple(part.column("ids").to_pylist()[0]), properties, has, binary)
                elif elements[at] == 1:
                    now.vertices({p: part.column(p).to_numpy(zero_copy_only=False) for p, _ in properties})
                else:
                    now.lists(int(elements[at]) - 1, part.column("ids").to_pylist())
                at = end
        finish()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "path", "n_vertices", "n_edges", "n_faces"])

    ordered = rows.repartition("file").sortWithinPartitions("file", "element", "at").select("file", "element", *[p for p, _ in properties], "ids")
    return cut_lineage(ordered.mapInArrow(run, "file string, path string, n_vertices long, n_edges long, n_faces long"))


# Tiles


#: Columns of a tile index. Fixed values.
INDEX = ("tile_id", "i", "j", "k", *[f"origin_{a}" for a in XYZ], "n_points", *[f"{e}_{a}" for e in ("min", "max") for a in XYZ])


def tile_index(placed: DataFrame, least: int) -> DataFrame:
    """tile_points() -> a row a tile of at least `least` points."""
    box = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in XYZ]
    tiles = placed.groupBy("i", "j", "k").agg(F.count("*").alias("n_points"), *[F.first(f"o{a}").alias(f"origin_{a}") for a in XYZ], *box).where(F.col("n_points") >= least)
    return tiles.withColumn("tile_id", F.format_string("x%d_y%d_z%d", "i", "j", "k")).select(*INDEX)


def _las(columns: dict[str, np.ndarray]) -> bytes:
    colours = np.stack([columns[c] for c in COLOURS], axis=1) if set(COLOURS) <= columns.keys() else None
    return las_bytes(*[columns[a] for a in XYZ], colours)


def _npz(columns: dict[str, np.ndarray]) -> bytes:
    """The full point record; columns that are missing are 0, ids -1, planes nan."""
    n = len(columns["x"])
    block = lambda names, dtype, none: np.stack([columns.get(c, np.full(n, none)) for c in names], axis=1).astype(dtype)
    out = io.BytesIO()
    np.savez(out, coords=block(XYZ, "f8", 0), colors=block(COLOURS, "u1", 0), ids=block(RECORD_IDS, "i4", -1), planes=block("abcd", "f8", np.nan))
    return out.getvalue()


#: Ids of the full point record, in order. Fixed values.
RECORD_IDS = ("point_id", "joint_id", "joint_cluster_id", "cluster_id")
_ENCODERS = {"las": _las, "npz": _npz}


def write_point_files(rows: DataFrame, folder: str, properties: list[tuple[str, str]], order: str, kind: str = "ply") -> DataFrame:
    """file, save_path, n_in_file: a file of the properties for each value of `file`, its points sorted by order. kind:
    ply (binary), las (x, y, z and colours, in steps of a millimetre) or npz (the full point record). A file's points
    are gathered by a task, for its header tells their number: deal large ones to several files first. The files are
    written when this returns."""
    ready = rows.repartition("file").sortWithinPartitions("file", order).select("file", *[F.col(p).cast(kind if kind in ("float", "double") else "long").alias(p) for p, kind in properties])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.RecordBatch] = []
        done = []

        def finish() -> None:
            if gathered:
                table = pa.Table.from_batches(gathered)
                name, columns = table.column("file")[0].as_py(), {p: table.column(p).to_numpy() for p, _ in properties}
                if kind == "ply":
                    out = _Open(folder, name, (table.num_rows, 0, 0), properties, (False, False), True)
                    out.vertices(columns)
                    out.close()
                    path = out.path
                else:
                    path = _whole(folder, f"{name}.{kind}", _ENCODERS[kind](columns))
                done.append((name, path, table.num_rows))
                gathered.clear()

        for batch in batches:
            names = batch.column("file").to_pylist()
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if gathered and gathered[0].column("file")[0].as_py() != names[at]:
                    finish()
                gathered.append(batch.slice(at, end - at))
                at = end
        finish()
        columns = list(zip(*done, strict=True)) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["file", "save_path", "n_in_file"])

    return cut_lineage(ready.mapInArrow(run, "file string, save_path string, n_in_file long"))


def _whole(folder: str, name: str, content: bytes) -> str:
    """Write a file under a name of the task's own, and give it its name once it is whole."""
    fs, top, _ = file_system(folder)
    fs.create_dir(top, recursive=True)
    part = f"{top}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, f"{top}/{name}")
    return f"{top}/{name}"


def write_clouds(points: DataFrame, folder: str, by: str, kind: str = "las", most_points: int = 1_000_000, order: str = "pid") -> DataFrame:
    """file, save_path, n_in_file: a cloud for each value of `by`, as files of this kind; one of more than most_points
    has several. The columns of the kind's record that points has are written."""
    record = {"las": (*XYZ, *COLOURS), "npz": (*XYZ, *COLOURS, *RECORD_IDS, *"abcd")}[kind]
    floats = {*XYZ, *"abcd"}
    properties = [(c, "double" if c in floats else "int") for c in record if c in points.columns]
    sizes = points.groupBy(by).agg(F.count("*").alias("_n"))
    named = points.join(sizes, by).withColumn("_name", F.col(by).cast("string"))
    return write_point_files(_dealt(named, "_name", "_n", most_points, order), folder, properties, order, kind)


def write_xyz(points: DataFrame, path: str, order: str, label: str | None = None) -> None:
    """Text files of x, y, z and a label in six decimals, in ranges of order, each sorted."""
    shown = [F.format_string("%.6f", F.col(a)) for a in XYZ] + ([F.col(label).cast("string")] if label else [])
    points.select(order, F.concat_ws(" ", *shown).alias("line")).repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def _dealt(rows: DataFrame, name: str, count: str, most_points: int, order: str) -> DataFrame:
    """rows with `file`: the name, or one of several where the count is over most_points, by the hash of `order`."""
    many = F.ceil(F.col(count) / most_points)
    return rows.withColumn("file", F.when(many <= 1, F.col(name)).otherwise(F.concat_ws("_part", name, F.pmod(F.xxhash64(order), many).cast("string"))))


def write_tiles(points: DataFrame, folder: str, size: float, overlap: float = 0.0, least: int = 1, most_points: int = 1_000_000, order: str = "pid", fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """Cut a cloud into cubes and write each with at least `least` points as PLY; below folder there are `tiles/*.ply`
    and `index`, a CSV with a row for each file (and header). The index's rows are returned as written.

    A tile of more than most_points is dealt to several files by the hash of its points' `order`, a unique id, by which
    the points of a file are sorted. fields: properties besides x, y, z. The index is written after all files are
    whole, so it never names one that is not."""
    fields = fields or []
    properties = [*[(a, "double") for a in XYZ], *fields]
    keep = list(dict.fromkeys([order, *XYZ, *[f for f, _ in fields]]))
    placed = cut_lineage(tile_points(points.select(*keep), size, overlap))
    index = cut_lineage(tile_index(placed, least))
    dealt = cut_lineage(_dealt(placed.join(index.select("i", "j", "k", "tile_id", "n_points"), ["i", "j", "k"]), "tile_id", "n_points", most_points, order))
    written = write_point_files(dealt, f"{folder}/tiles", properties, order)
    whole = index.join(dealt.select("tile_id", "file").distinct(), "tile_id").join(written, "file").drop("file").orderBy("i", "j", "k", "save_path")
    whole.write.mode("overwrite").option("header", True).csv(f"{folder}/index")
    return points.sparkSession.read.schema(whole.schema).option("header", True).csv(f"{folder}/index")


def write_cubes(points: DataFrame, folder: str, name: str, size: float, stride: float | None = None, least: int = 500, most_points: int = 1_000_000, inits: int = 10, rounds: int = 15, order: str = "pid") -> DataFrame:
    """Cut a cloud with normals (order, x, y, z, nx, ny, nz) into cubes of `size` every `stride`, find the directions of
    the normals of each cube with `least` points or more, and write these as PLY in the colours of their directions.
    Below folder there are `cubes/*.ply`, named after place, size, number of points and directions, and `manifest`, a
    CSV with a row for each file. The manifest's rows are returned as written.

    Cubes begin before the cloud's upper corner; one of more than most_points has several files."""
    from strataspark.operators.directions import evaluate, label_colours, text_of

    stride = stride or size
    high = points.agg(*[F.max(a).alias(f"_h{a}") for a in XYZ])
    placed = tile_points(points.select(order, *XYZ, "nx", "ny", "nz"), size, size - stride).crossJoin(F.broadcast(high))
    for a in XYZ:
        placed = placed.where(F.col(f"o{a}") < F.col(f"_h{a}"))
    place = ["i", "j", "k"]
    sizes = placed.groupBy(*place).agg(F.count("*").alias("n_points"), *[F.first(f"o{a}").alias(f"{a}0") for a in XYZ]).where(F.col("n_points") >= least)
    kept = cut_lineage(placed.join(sizes, place).drop("ox", "oy", "oz", "_hx", "_hy", "_hz"))
    normals = kept.select(*place, order, *[F.col(f"n{a}").alias(a) for a in XYZ])
    groups, labels = evaluate(normals, place, inits, rounds, key=order)
    number = lambda c: F.regexp_replace(F.round(c, 3).cast("string"), r"\.0$", "")
    title = F.concat_ws("_", F.lit(f"{name}_Cube"), *[F.concat(F.lit(a), F.col(k).cast("string")) for a, k in zip(XYZ, "ijk", strict=True)], *[F.concat(F.lit(a.upper()), number(f"{a}0")) for a in XYZ], F.lit(f"S{size:g}"), F.lit(f"T{stride:g}"), F.concat(F.lit("N"), F.col("n_points").cast("string")), F.concat(F.lit("K"), F.col("best_k").cast("string")))
    manifest = cut_lineage(text_of(groups).drop("n").join(kept.select(*place, "n_points", "x0", "y0", "z0").distinct(), place).withColumn("cube", title))
    dealt = _dealt(kept.drop("x0", "y0", "z0").join(labels, [*place, order]).join(manifest.select(*place, "cube"), place), "cube", "n_points", most_points, order)
    dealt = cut_lineage(dealt.select("*", *label_colours(F.col("label"))))
    properties = [*[(a, "double") for a in (*XYZ, "nx", "ny", "nz")], *[(c, "uchar") for c in COLOURS]]
    written = write_point_files(dealt, f"{folder}/cubes", properties, order)
    rows = manifest.join(dealt.select("cube", "file").distinct(), "cube").join(written, "file")
    whole = rows.select(F.lit(name).alias("src_file"), F.col("save_path").alias("cube_file"), *[F.col(k).alias(f"i{a}") for a, k in zip(XYZ, "ijk", strict=True)], "x0", "y0", "z0", F.lit(size).alias("cube_size"), F.lit(stride).alias("stride"), "n_points", "n_in_file", "best_k", "score", F.col("kind").alias("score_kind"), "is_clustered", "proportions", "pair_angles_deg", "centers").orderBy("ix", "iy", "iz", "cube_file")
    whole.write.mode("overwrite").option("header", True).csv(f"{folder}/manifest")
    return points.sparkSession.read.schema(whole.schema).option("header", True).csv(f"{folder}/manifest")


def read_bodies(spark, folder: str, element: str = "vertex") -> DataFrame:
    """file (name without ending), <element>_index and the element's properties of all files below folder."""
    register(spark)
    rows = spark.read.format("ply").option("element", element).load(folder)
    name = F.substring_index("path", "/", -1)  # a pattern would be sought from every letter of every row's path
    ending = F.length(F.substring_index(name, ".", -1)) + 1
    return rows.withColumn("file", F.substring(name, F.lit(1), F.length(name) - ending)).drop("path")
