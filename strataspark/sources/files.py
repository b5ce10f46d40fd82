"""Point files: PLY (ascii and binary), XYZ, LAS 1.2 and NPZ, read and written.

PLY and LAS are read in byte ranges by the sources of formats.py; text formats that split go through Spark's text
readers, NPZ through binaryFile. Binary files are written by the tasks into a folder that driver and executors share,
under a name of the task's own that is renamed once the file is whole.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.sources.formats import PLY_TYPES, SPLIT_BYTES, file_system, register


def _load(spark: SparkSession, kind: str, path: str, columns: list[str] | None, recursive: bool, split_bytes: int, **more: int) -> DataFrame:
    register(spark)
    options = {"splitBytes": split_bytes, "recursive": str(recursive).lower()} | {k: v for k, v in more.items() if v is not None}
    if columns is not None:
        options["columns"] = ",".join(columns)
    return spark.read.format(kind).options(**options).load(path)


def read_ply(spark: SparkSession, path: str, columns: list[str] | None = None, recursive: bool = False, element: str = "vertex", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, vertex_index and the vertices' properties (or the columns that are named) of a PLY file, or of those in a
    folder; the first file's header tells the schema. element: another element of the files, with its own index. An empty
    cloud is an empty table; operators.lookup.not_empty makes an error of it."""
    return _load(spark, "ply", path, columns, recursive, split_bytes, element=element)


def read_vertex(spark: SparkSession, path: str, index: int, columns: list[str] | None = None) -> DataFrame:
    """The vertex of this number of a PLY file: one record is read."""
    return _load(spark, "ply", path, columns, False, SPLIT_BYTES, firstRecord=index, lastRecord=index)


def read_las(spark: SparkSession, path: str, columns: list[str] | None = None, recursive: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, vertex_index, x, y, z, red, green, blue, intensity, classification of LAS files (LAZ is not read)."""
    return _load(spark, "las", path, columns, recursive, split_bytes)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and a label (null if there is none) of text files of three columns or more; other lines are left out."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 3)
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    return rows.select(number(0).alias("x"), number(1).alias("y"), number(2).alias("z"), number(3).cast("int").alias("label")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def ply_lines(vertices: DataFrame, order: str, properties: list[tuple[str, str]], edges: DataFrame | None = None, faces: DataFrame | None = None, counts: tuple[int, int, int] | None = None) -> DataFrame:
    """(part, at, line): the lines of an ascii PLY file, in order of (part, at). edges: (at, i, j); faces: (at, ids)."""
    n, m, k = counts or (vertices.count(), edges.count() if edges is not None else 0, faces.count() if faces is not None else 0)
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property {t} {p}" for p, t in properties]]
    if edges is not None:
        head += [f"element edge {m}", "property int vertex1", "property int vertex2"]
    if faces is not None:
        head += [f"element face {k}", "property list uchar int vertex_indices"]
    spark = vertices.sparkSession
    lines = spark.range(1).select(F.posexplode(F.array(*map(F.lit, [*head, "end_header"]))).alias("at", "line")).select(F.lit(0).alias("part"), F.col("at").cast("long").alias("at"), "line")
    shown = lambda c, t: F.col(c).cast("string") if t not in ("float", "double") else F.format_string("%.6f", F.col(c).cast("double"))
    lines = lines.unionByName(vertices.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("at"), F.concat_ws(" ", *[shown(p, t) for p, t in properties]).alias("line")))
    if edges is not None:
        lines = lines.unionByName(edges.select(F.lit(2).alias("part"), F.col("at").cast("long").alias("at"), F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string")).alias("line")))
    if faces is not None:
        lines = lines.unionByName(faces.select(F.lit(3).alias("part"), F.col("at").cast("long").alias("at"), F.concat_ws(" ", F.size("ids").cast("string"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("line")))
    return lines


def write_ply_ascii(lines: DataFrame, path: str) -> None:
    """One file below path: a PLY file has one header, so its lines meet in one task (they are sorted and streamed)."""
    lines.repartition(1).sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)


def write_ply_binary(points: DataFrame, folder: str, by: str, properties: list[tuple[str, str]]) -> DataFrame:
    """(by, path, n): a little-endian PLY file for each value of by, named after it."""
    dtype = np.dtype([(p, "<" + PLY_TYPES[t][0]) for p, t in properties])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.empty(table.num_rows, dtype=dtype)
        for p, _ in properties:
            rows[p] = table.column(p).to_numpy()
        head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *[f"property {t} {p}" for p, t in properties], "end_header", ""])
        fs, top, _ = file_system(folder)
        fs.create_dir(top, recursive=True)
        name, part = f"{top}/{key[0].as_py()}.ply", f"{top}/.{key[0].as_py()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(head.encode() + rows.tobytes())
        fs.move(part, name)
        return pa.table({by: table.column(by).slice(0, 1), "path": [name], "n": [len(rows)]})

    kind = dict(points.dtypes)[by]
    return points.select(by, *[p for p, _ in properties]).groupBy(by).applyInArrow(run, f"{by} {kind}, path string, n long")


def las_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, rgb: np.ndarray | None = None, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of point format 3."""
    n = len(x)
    low = [float(c.min()) if n else 0.0 for c in (x, y, z)]
    high = [float(c.max()) if n else 0.0 for c in (x, y, z)]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I12d", b"LASF", 0, 0, 0, 0, 0, b"\0" * 8, 1, 2, b"strataspark".ljust(32, b"\0"), b"strataspark".ljust(32, b"\0"), 1, 2024, 227, 227, 0, 3, 34, n, n, 0, 0, 0, 0, scale, scale, scale, *low, high[0], low[0], high[1], low[1], high[2], low[2])
    rows = np.zeros(n, dtype=np.dtype([("p", "<i4", 3), ("rest", "u1", 8), ("t", "<f8"), ("rgb", "<u2", 3)]))
    for i, c in enumerate((x, y, z)):
        rows["p"][:, i] = np.round((c - low[i]) / scale)
    if rgb is not None:
        rows["rgb"] = rgb.astype(np.uint16) * 256
    return head + rows.tobytes()


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """The full point record of NPZ files: coords, colors, ids, planes."""
    names = ["x", "y", "z", "red", "green", "blue", "point_id", "joint_id", "joint_cluster_id", "cluster_id", "a", "b", "c", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                f = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                cols = [*f["coords"].T.astype(np.float64), *f["colors"].T.astype(np.int16), *f["ids"].T.astype(np.int32), *f["planes"].T.astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    schema = ", ".join(f"{n} {'double' if i < 3 or i > 9 else 'short' if i < 6 else 'int'}" for i, n in enumerate(names))
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
