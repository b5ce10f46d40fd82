"""WARC archives: writing, normalising monolithic gzip, reading by offset.

Archives are written as one gzip stream over the whole file. The normaliser inflates such a stream once, in pieces,
rewrites every record as a gzip member of its own and writes a sidecar index with each member's offset and length;
readers then open any record without inflating what precedes it.

Records with payloads of equal digests are written once, as a response; the others are revisits of it. The least that
is known of every digest (its largest page_id and the number of its pages) is pre-aggregated; no group is collected.

Files go to a folder that driver and executors share, opened with pyarrow's file systems by URI. A file's name holds
its task attempt, and only the files that the successful tasks report are read, so that a lost executor leaves
unread files at worst. Every file is renamed into place once it is whole.

Defined cases: a null html is an empty payload; null page_ids are revisits of the group's largest id, or responses
where a group has no id; rows that repeat the largest id are responses like it; null urls leave their header out; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.base import materialize

LEVEL = 6
PIECE = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_FILES = "path string, index string, records long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str, mode: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path, (fs.open_input_stream(path, compression=None) if mode == "rb" else fs.open_output_stream(path, compression=None))


def _part(uri: str) -> str:
    """What an attempt writes before the file has its name: attempts that run at once do not share it."""
    return f"{uri}.{_attempt()}.part"


def _renamed(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.move(_part(path), path)


def record_id(page_id: int | None, digest: str, turn: str = "") -> str:
    """A response's id, which revisits name; turn tells other records of a page apart from it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}:{turn}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format's digest


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None, turn: str = "") -> bytes:
    """One WARC record; turn as in record_id. A revisit's block ends with the HTTP headers; its payload is that of the record it names."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, turn)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's headers by lower-case name, its HTTP headers and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip file of one member or several."""
    engine = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            out = engine.decompress(data, PIECE)
            if out:
                yield out
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                data = engine.unconsumed_tail
    if tail := engine.flush():
        yield tail


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC stream, whole, one at a time."""
    have = bytearray()
    need = None
    for piece in pieces:
        have += piece
        while True:
            if need is None:
                at = have.find(b"\r\n\r\n")
                if at < 0:
                    break
                length = next(int(x[15:]) for x in bytes(have[:at]).split(b"\r\n") if x[:15].lower() == b"content-length:")
                need = at + 4 + length + 4
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = None
    if have:
        raise ValueError("the archive ends within a record")


def normalise(source: str, target: str, level: int = LEVEL) -> tuple[str, int]:
    """Rewrite an archive with a member a record; writes target and target.idx (JSON lines: offset, length, page_id,
    type). Returns the index's URI and the number of records."""
    offset = count = 0
    *_, src = _open(source, "rb")
    *_, out = _open(_part(target), "wb")
    *_, idx = _open(_part(f"{target}.idx"), "wb")
    with src, out, idx:
        for raw in split_records(inflated(src)):
            headers, _, _ = parse(raw)
            engine = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = engine.compress(raw) + engine.flush()
            out.write(member)
            idx.write(json.dumps({"offset": offset, "length": len(member), "page_id": headers.get("x-page-id"), "type": headers["warc-type"]}).encode() + b"\n")
            offset += len(member)
            count += 1
    _renamed(target)
    _renamed(f"{target}.idx")
    return f"{target}.idx", count


def read_member(stream, offset: int, length: int) -> bytes:
    stream.seek(offset)
    return zlib.decompress(stream.read(length), 31)


def _attempt() -> str:
    ctx = TaskContext.get()
    return f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}" if ctx else "000000-0"


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, size, keeper: the page whose record holds the payload, null for a response, and
    named: whether revisits name the record. Its id follows from the page and the payload (repeated rows of that page are
    one record, written as often); the ids of all other records follow from their place."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    keepers = rows.where(F.col("size") >= least).groupBy(F.col("sha").alias("k_sha")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 AND keeper IS NOT NULL")
    joined = rows.join(keepers.select("k_sha", "keeper"), F.col("sha") == F.col("k_sha"), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha", "size", F.when(revisit, F.col("keeper")).alias("keeper"), F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False)).alias("named"))


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """One archive a partition, as one gzip stream. Returns path, index (null), records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, count = f"{folder}/raw-{_attempt()}.warc.gz", None, 0
        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, payload, sha, size, keeper, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    *_, out = _open(_part(path), "wb")
                turn = "" if named else f"{path.rpartition('/')[2]}:{count}"
                raw = record("response" if keeper is None else "revisit", page_id, url, payload or b"", base64.b32encode(sha).decode(), size, keeper, turn)
                out.write(engine.compress(raw))
                count += 1
        if out is not None:
            out.write(engine.flush())
            out.close()
            _renamed(path)
            yield pa.RecordBatch.from_pydict({"path": [path], "index": pa.array([None], pa.string()), "records": [count]})

    return plan.select("page_id", "url", "payload", "sha", "size", "keeper", "named").mapInArrow(write, _FILES)


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every archive rewritten with a member a record; the whole-stream file is removed once its successor is whole.

    A task that is run again may find its source gone; it then takes the successor that the earlier attempt left."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, count in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                target = f"{folder}/{source.rpartition('/')[2].replace('raw-', 'members-')}"
                fs, path = pafs.FileSystem.from_uri(target)
                done = fs.get_file_info([path, f"{path}.idx"])
                if any(x.type != pafs.FileType.File for x in done):
                    index, found = normalise(source, target)
                    if found != count:
                        raise ValueError(f"{source}: {found} records, {count} written")
                sfs, spath = pafs.FileSystem.from_uri(source)
                if sfs.get_file_info(spath).type == pafs.FileType.File:
                    sfs.delete_file(spath)
                yield pa.RecordBatch.from_pydict({"path": [target], "index": [f"{target}.idx"], "records": [count]})

    return files.mapInArrow(rewrite, _FILES)


def read_archives(files: DataFrame) -> DataFrame:
    """The records of normalised archives, by their indexes. A response's digest is computed anew and compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist(), strict=True):
                *_, idx = _open(index, "rb")
                with idx:
                    entries = [json.loads(x) for x in idx.read().splitlines()]
                fs, place = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with fs.open_input_file(place) as stream:
                    for entry in entries:
                        headers, http, payload = parse(read_member(stream, entry["offset"], entry["length"]))
                        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                        size = next(int(x[15:]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:")
                        if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                            raise ValueError(f"{path} at {entry['offset']}: the payload is not what its headers say")
                        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.mapInArrow(read, _RECORDS)


def archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages as archives under folder, normalise them, and return the records that the archives hold.

    The folder's URI must be one that driver and executors share."""
    pafs_fs, path = pafs.FileSystem.from_uri(folder)
    pafs_fs.create_dir(path, recursive=True)
    written = materialize(write_archives(planned(pages, least), folder))
    tasks = max(1, written.count())
    normal = materialize(normalise_archives(written.repartition(tasks), folder))
    return read_archives(normal.repartition(tasks))


def remove(folder: str) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.delete_dir(path)


