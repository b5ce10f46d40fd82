"""What the operators of this subpackage share: words, tables, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between spaces and the control characters from tab to carriage return. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _top(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. A temporary one of our own only where none is
    named and driver and executors are one process, as in tests; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="strataspark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one."""
    top = _top(spark)
    return f"{top if '://' in top or top.startswith('file:') else 'file://' + top}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_top(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours, by way of the file system that its URI names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Intermediate tables as Parquet below the shared folder: they outlive executors, cut the lineage, and go with
    clear()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.many = spark, shared_folder(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.many}"
        self.many += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.folder)


#: Bytes of an Arrow batch that Python gets.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are cut by bytes, not only by rows, from here on in the session; a lower bound stays."""
    most = spark.conf.get(_BATCH)
    if not (most.isdigit() and 0 < int(most) <= BATCH_BYTES):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


_CARRIED = "_carried_columns"


def carry(docs: DataFrame, *own: str, columns: list[str] | None = None) -> DataFrame:
    """docs with its own columns and all others (or those named) in one struct, where they cannot clash with names that
    an operator makes."""
    others = [c for c in (docs.columns if columns is None else columns) if c not in own]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    return docs.select(*[f"`{c}`" for c in own if c in docs.columns], packed.alias(_CARRIED))


def unpacked(name: str) -> Column:
    """A column that carry() packed, by its own name."""
    return F.col(_CARRIED).getField(name).alias(name)


def carried(df: DataFrame, columns: list[str], own: tuple[str, ...], *more: str) -> DataFrame:
    """The columns in their order, packed ones from the struct, and more; of equal names the later one stays."""
    return df.select(*[F.col(f"`{c}`") if c in own else unpacked(c) for c in columns if c not in more], *more)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bitmap(df: DataFrame, *key: str) -> np.ndarray:
    """Which places the hashes of df's keys take."""
    return bitmap_of(df, F.xxhash64(*key))


def bitmap_of(df: DataFrame, number: Column, bits: int = 1 << 23) -> np.ndarray:
    """Which of `bits` places (a power of two) the numbers take, as 32-bit words: bits / 8 bytes, whatever the size
    of df."""
    place = F.pmod(number, F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = df.groupBy(F.floor(place / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, dtype="<i8")
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view("<u4")


def bits_for(many: int, least: int = 1 << 16, most: int = 1 << 26) -> int:
    """Size of a bitmap of `many` entries: some sixteenth of the places are taken, up to 8 MB. A table that needs more
    gets a fuller bitmap, which lets more rows through to the joins behind it."""
    return min(max(1 << max(16 * many - 1, 1).bit_length(), least), most)


def in_bitmap(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers the bitmap may hold."""
    place = numbers.astype(np.int64) & (len(bits) * 32 - 1)
    return (bits[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool)
