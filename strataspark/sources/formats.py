"""PLY and LAS as data sources of Spark whose files are read in byte ranges.

    register(spark)
    spark.read.format("ply").option("columns", "x,y,z").load("file:///clouds")

A file of fixed records is split into ranges of `splitBytes`; a task reads the header and the records that begin in its
range, so one large file is read by many tasks and none holds it whole. Where there are very many small ranges, a task
takes several. Records are cut to the columns that are named.
firstRecord and lastRecord seek to those records of each file. Elements with lists, and ascii files, have
no fixed records: one task reads such a file, a piece at a time.

Options: columns (comma-separated, all by default), splitBytes, firstRecord, lastRecord, recursive, and for PLY element
(vertex by default).
Files are opened by pyarrow's file systems, by URI or path.
"""

from __future__ import annotations

import io
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: PLY's type names: numpy code, Spark type. Fixed values.
PLY_TYPES = {
    "char": ("i1", "short"), "int8": ("i1", "short"), "uchar": ("u1", "short"), "uint8": ("u1", "short"), "short": ("i2", "short"), "int16": ("i2", "short"), "ushort": ("u2", "int"), "uint16": ("u2", "int"),
    "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "long"), "uint32": ("u4", "long"), "float": ("f4", "float"), "float32": ("f4", "float"), "double": ("f8", "double"), "float64": ("f8", "double"),
}
#: Records that are decoded at once.
PIECE = 200_000
SPLIT_BYTES = 64 << 20
#: Ranges up to this number are a task each; more are put together, up to SPLIT_BYTES a task, and opening a file counts
#: as so many bytes.
MOST_TASKS = 256
OPEN_BYTES = 16 << 10
#: numpy codes of what Spark has no type for, and the next larger one.
_WIDER = {"i1": "i2", "u1": "i2", "u2": "i4", "u4": "i8"}


def parse_header(head: bytes) -> tuple[str, list[tuple[str, int, list]], int]:
    """(format, elements as (name, count, [(property, type)]), bytes of the header). List properties have a tuple
    (count type, item type) as type."""
    end = re.search(rb"end_header\r?\n", head)
    if not head.startswith(b"ply") or end is None:
        raise ValueError("not a PLY file")
    kind, elements = "", []
    for line in head[: end.start()].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append((words[-1], (words[2], words[3]) if words[1] == "list" else words[1]))
    return kind, elements, end.end()


def read_header(file: pa.NativeFile) -> tuple[str, list[tuple[str, int, list]], int]:
    """The header of an open file, however long it is."""
    head, size = b"", file.size()
    while True:
        more = file.read_at(min(1 << 16, size - len(head)), len(head))
        head += more
        if b"end_header" in head[:-2] or not more:
            return parse_header(head)


def spark_type(kind: str | tuple[str, str]) -> str:
    return PLY_TYPES[kind][1] if isinstance(kind, str) else f"array<{PLY_TYPES[kind[1]][1]}>"


def fields_of(elements: list, name: str) -> list[tuple[str, str | tuple[str, str]]]:
    fields = next((p for n, _, p in elements if n == name), None)
    if fields is None or (name == "vertex" and not {"x", "y", "z"} <= {n for n, _ in fields}):
        raise ValueError("the file has no vertices with x, y, z" if name == "vertex" else f"the file has no element {name}")
    return fields


def fixed(fields: list) -> bool:
    return all(isinstance(t, str) for _, t in fields)


def record(fields: list, order: str) -> np.dtype:
    return np.dtype([(f, order + PLY_TYPES[t][0]) for f, t in fields])


def native(values: np.ndarray) -> np.ndarray:
    """In this machine's byte order, in a type that Spark has."""
    code = values.dtype.str[1:]
    return values.astype(_WIDER.get(code, code))


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path within it, what stands before that in the full name) of a path or URI. Local names are taken
    as they are, with characters that a URI would have to escape."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path, ""
    if path.startswith("file:"):
        inner = re.sub("^file:(//)?", "", path)
        return pafs.LocalFileSystem(), inner, path[: len(path) - len(inner)]
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner, path[: -len(inner)] if path.endswith(inner) else ""


@dataclass
class Files:
    """A file, or the files of a folder with one of the endings, as (full name, size)."""

    path: str
    endings: tuple[str, ...]
    recursive: bool

    def open(self, name: str) -> pa.NativeFile:
        fs, _, before = file_system(self.path)
        return fs.open_input_file(name[len(before) :])

    def list(self) -> list[tuple[str, int]]:
        fs, top, before = file_system(self.path)
        info = fs.get_file_info(top)
        if info.type == pafs.FileType.File:
            return [(before + info.path, info.size)]
        if info.type != pafs.FileType.Directory:
            raise FileNotFoundError(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(top, recursive=self.recursive)) if x.type == pafs.FileType.File and x.base_name.lower().endswith(self.endings) and x.base_name[0] not in "._"]
        return sorted((before + x.path, x.size) for x in found)


@dataclass
class Range:
    path: str
    first: int
    last: int
    size: int


@dataclass
class Ranges(InputPartition):
    """Ranges of one task: what their paths begin with, and for each the rest of its path, first, last and size."""

    top: str
    held: list[tuple[str, int, int, int]]


def put_together(pieces: list[Range]) -> list[Ranges]:
    """A range a task, or neighbouring ones together where they are many and small."""
    top = os.path.commonprefix([pieces[0].path, pieces[-1].path]) if pieces else ""  # paths are sorted
    weight = lambda p: p.last - p.first + OPEN_BYTES
    most = 0 if len(pieces) <= MOST_TASKS else min(SPLIT_BYTES, -(-sum(map(weight, pieces)) // MOST_TASKS))
    tasks, full = [], 0
    for p in pieces:
        if not tasks or full + weight(p) > most:
            tasks.append(Ranges(top, []))
            full = 0
        tasks[-1].held.append((p.path[len(top) :], p.first, p.last, p.size))
        full += weight(p)
    return tasks


class RangeReader(DataSourceReader):
    """Byte ranges of files, for the columns in names; number is the column of a record's number."""

    def __init__(self, files: Files, names: list[str], options: dict[str, str], number: str):
        self.files, self.names, self.number = files, names, number
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.least, self.most = int(options.get("firstRecord", 0)), int(options.get("lastRecord", 1 << 62))

    def partitions(self) -> list[Ranges]:
        return put_together([Range(path, at, min(at + self.split, size), size) for path, size in self.files.list() for at in range(0, max(size, 1), self.split)])

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        for rest, *where in task.held:
            yield from self.read_range(Range(task.top + rest, *where))

    def records(self, piece: Range, at: int, width: int, many: int) -> tuple[int, int]:
        """Numbers (from, to) of the records, `many` of this width from byte `at` on, that begin in the range and are
        asked for."""
        ahead = lambda byte: min(max(0, -((at - byte) // width)), many)  # noqa: E731  records that begin before the byte
        last = many if piece.last == piece.size else ahead(piece.last)  # what a file lacks is missed by its last range
        return max(ahead(piece.first), self.least), min(last, self.most + 1)

    def batches(self, file: pa.NativeFile, path: str, at: int, dtype: np.dtype, first: int, last: int, columns) -> Iterator[pa.RecordBatch]:
        for start in range(first, last, PIECE):
            n = min(PIECE, last - start)
            data = file.read_at(n * dtype.itemsize, at + start * dtype.itemsize)
            if len(data) < n * dtype.itemsize:
                raise ValueError(f"{path} ends before its last record")
            yield self.batch(path, start, columns(np.frombuffer(data, dtype=dtype)), n)

    def batch(self, path: str, start: int, columns: dict[str, np.ndarray | list], n: int) -> pa.RecordBatch:
        arrays = {"path": lambda: pa.array([path] * n, pa.string()), self.number: lambda: pa.array(np.arange(start, start + n, dtype=np.int64))}
        return pa.RecordBatch.from_arrays([arrays[c]() if c in arrays else pa.array(columns[c]) for c in self.names], names=self.names)


class PlyReader(RangeReader):
    def __init__(self, files: Files, names: list[str], options: dict[str, str], element: str, kinds: dict[str, str]):
        super().__init__(files, names, options, f"{element}_index")
        self.element, self.kinds = element, kinds

    def read_range(self, piece: Range) -> Iterator[pa.RecordBatch]:
        with self.files.open(piece.path) as file:
            kind, elements, at = read_header(file)
            own = fields_of(elements, self.element)
            missing = [c for c in self.names if c not in ("path", self.number) and c not in dict(own)]
            if missing:
                raise ValueError(f"{piece.path} has no {', '.join(missing)}")
            if kind == "ascii":
                if piece.first == 0:
                    yield from self._lines(file, piece.path, elements, at)
                return
            order = "<" if "little" in kind else ">"
            for name, count, fields in elements:
                if name == self.element and fixed(fields):
                    dtype = record(fields, order)
                    first, last = self.records(piece, at, dtype.itemsize, count)
                    yield from self.batches(file, piece.path, at, dtype, first, last, lambda rows: {c: native(rows[c]) for c in rows.dtype.names if c in self.names})
                    return
                if name == self.element:
                    if piece.first == 0:
                        yield from self._lists(file, piece.path, at, order, count, fields)
                    return
                if not fixed(fields):
                    if piece.first != 0:
                        return  # what follows lists has no known place: the first range reads it
                    at = self._skip(file, at, order, count, fields)
                    piece = Range(piece.path, 0, piece.size, piece.size)
                    continue
                at += count * record(fields, order).itemsize

    def _walk(self, file: pa.NativeFile, at: int, order: str, count: int, fields: list) -> Iterator[tuple[dict, int]]:
        """Every record of an element with lists, and the byte behind it."""
        file.seek(at)
        stream = io.BufferedReader(file, 1 << 20)
        try:
            for _ in range(count):
                values = {}
                for f, t in fields:
                    head = 0 if isinstance(t, str) else np.dtype(PLY_TYPES[t[0]][0]).itemsize
                    many, item = (1, t) if isinstance(t, str) else (int(np.frombuffer(stream.read(head), order + PLY_TYPES[t[0]][0])[0]), t[1])
                    dtype = np.dtype(order + PLY_TYPES[item][0])
                    data = stream.read(many * dtype.itemsize)
                    at += head + len(data)
                    got = native(np.frombuffer(data, dtype))
                    values[f] = got[0] if isinstance(t, str) else got
                yield values, at
        finally:
            stream.detach()  # else the file would be closed with it

    def _skip(self, file: pa.NativeFile, at: int, order: str, count: int, fields: list) -> int:
        for _, at in self._walk(file, at, order, count, fields):
            pass
        return at

    def _lists(self, file: pa.NativeFile, path: str, at: int, order: str, count: int, fields: list) -> Iterator[pa.RecordBatch]:
        yield from self._gathered(path, (values for values, _ in self._walk(file, at, order, count, fields)), count)

    def _gathered(self, path: str, rows: Iterator[dict], count: int) -> Iterator[pa.RecordBatch]:
        for start in range(0, count, PIECE):
            n = min(PIECE, count - start)
            piece = [next(rows) for _ in range(n)]
            low, high = max(self.least - start, 0), min(self.most + 1 - start, n)
            if low < high:
                yield self.batch(path, start + low, {c: pa.array([r[c] for r in piece[low:high]], self._arrow(c)) for c in self.names if c not in ("path", self.number)}, high - low)

    def _arrow(self, column: str) -> pa.DataType:
        plain = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        kind = self.kinds[column]
        return pa.list_(plain[kind[6:-1]]) if kind.startswith("array") else plain[kind]

    def _lines(self, file: pa.NativeFile, path: str, elements: list, at: int) -> Iterator[pa.RecordBatch]:
        file.seek(at)
        lines = io.BufferedReader(file, 1 << 20)
        for name, count, fields in elements:
            if name != self.element:
                for _ in range(count):
                    lines.readline()
                continue

            def rows(count: int = count, fields: list = fields) -> Iterator[dict]:
                for _ in range(count):
                    words = lines.readline().split()
                    if not words:
                        raise ValueError(f"{path} ends before its last {name}")
                    values = {}
                    for f, t in fields:
                        if isinstance(t, str):
                            values[f] = float(words.pop(0)) if PLY_TYPES[t][0][0] == "f" else int(float(words.pop(0)))
                        else:
                            n = int(words.pop(0))
                            values[f] = [float(w) if PLY_TYPES[t[1]][0][0] == "f" else int(w) for w in words[:n]]
                            del words[:n]
                    yield values

            yield from self._gathered(path, rows(), count)
            return


def _chosen(wanted: str | None, known: list[str]) -> list[str]:
    names = [c.strip() for c in wanted.split(",")] if wanted else known
    unknown = [c for c in names if c not in known]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    return names


class PlySource(DataSource):
    """path, <element>_index, and the element's properties; the first file's header tells the schema."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _files(self) -> Files:
        return Files(self.options["path"], (".ply",), self.options.get("recursive", "false").lower() == "true")

    def _fields(self) -> dict[str, str]:
        files = self._files()
        there = files.list()
        if not there:
            raise FileNotFoundError(f"no PLY file in {files.path}")
        with files.open(there[0][0]) as file:
            own = fields_of(read_header(file)[1], self._element())
        return {"path": "string", f"{self._element()}_index": "long", **{n: spark_type(t) for n, t in own}}

    def _element(self) -> str:
        return self.options.get("element", "vertex")

    def schema(self) -> str:
        fields = self._fields()
        return ", ".join(f"`{c}` {fields[c]}" for c in _chosen(self.options.get("columns"), list(fields)))

    def reader(self, schema) -> DataSourceReader:
        kinds = {f.name: "array<" + f.dataType.elementType.simpleString().replace("smallint", "short").replace("bigint", "long") + ">" if f.dataType.typeName() == "array" else f.dataType.simpleString().replace("smallint", "short").replace("bigint", "long") for f in schema.fields}
        return PlyReader(self._files(), schema.names, self.options, self._element(), kinds)


#: Columns of a LAS point. Fixed values.
LAS_COLUMNS = {"path": "string", "vertex_index": "long", "x": "double", "y": "double", "z": "double", "red": "int", "green": "int", "blue": "int", "intensity": "int", "classification": "int"}
#: Byte of the colours in a point of these formats, and of the classification. Fixed values.
_LAS_RGB = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


class LasReader(RangeReader):
    """LAS 1.0 to 1.4 of fixed records; compressed files (LAZ) are refused."""

    def read_range(self, piece: Range) -> Iterator[pa.RecordBatch]:
        with self.files.open(piece.path) as file:
            head = file.read_at(min(375, file.size()), 0)
            if head[:4] != b"LASF" or len(head) < 227:
                raise ValueError(f"{piece.path} is not a LAS file")
            at, kind, width, many = struct.unpack_from("<I", head, 96)[0], head[104], struct.unpack_from("<H", head, 105)[0], struct.unpack_from("<I", head, 107)[0]
            if kind & 0xC0:
                raise ValueError(f"{piece.path} is compressed")
            if head[25] >= 4 and len(head) >= 255:
                many = struct.unpack_from("<Q", head, 247)[0]
            scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
            names, formats, offsets = ["p", "intensity", "classification"], ["(3,)<i4", "<u2", "u1"], [0, 12, 15 if kind < 6 else 16]
            if kind in _LAS_RGB:
                names, formats, offsets = [*names, "rgb"], [*formats, "(3,)<u2"], [*offsets, _LAS_RGB[kind]]
            dtype = np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": width})

            def columns(rows: np.ndarray) -> dict[str, np.ndarray]:
                made = {a: rows["p"][:, i] * scale[i] + shift[i] for i, a in enumerate("xyz") if a in self.names}
                rgb = rows["rgb"] if "rgb" in names else np.zeros((len(rows), 3))
                made |= {c: rgb[:, i].astype(np.int32) for i, c in enumerate(("red", "green", "blue")) if c in self.names}
                made["intensity"] = rows["intensity"].astype(np.int32)
                made["classification"] = rows["classification"].astype(np.int32) & (0x1F if kind < 6 else 0xFF)
                return made

            first, last = self.records(piece, at, width, many)
            yield from self.batches(file, piece.path, at, dtype, first, last, columns)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return ", ".join(f"{c} {LAS_COLUMNS[c]}" for c in _chosen(self.options.get("columns"), list(LAS_COLUMNS)))

    def reader(self, schema) -> DataSourceReader:
        files = Files(self.options["path"], (".las",), self.options.get("recursive", "false").lower() == "true")
        return LasReader(files, schema.names, self.options, "vertex_index")


def register(spark: SparkSession) -> None:
    for source in (PlySource, LasSource):
        spark.dataSource.register(source)
