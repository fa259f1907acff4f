"""Shared plumbing: reading tables, the shared scratch folder, Arrow text blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space of every contract: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step handles; keeps its 8-byte temporaries small.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the
    session names none, a temporary one on a single machine, and an error on a cluster,
    whose executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="juriscope-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def size_hint(df: DataFrame) -> int:
    """Bytes that Catalyst expects ``df`` to have: file sizes for a scan. Only sizes
    of partitions follow from it, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(docs: DataFrame, text: Column) -> int:
    """Bytes of all texts, counted in one scan of that column."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).head()[0] or 0


def parts_for(size: int, each: int, least: int = 64) -> int:
    """How many parts of about ``each`` bytes ``size`` makes, however large it is."""
    return max(least, size // each)


def quoted(name: str) -> str:
    """A column's name as Spark's parser reads it: dots and blanks are part of it."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct with names c0, c1 and so on, so that no name
    of theirs, whatever it holds, meets a name that an operator uses inside."""
    return F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def restored(columns: list[str], row: str, **own: str) -> list[Column]:
    """The columns that ``carried`` packed, out of struct ``row``; ``own`` names columns to
    put in place of those of the same name, or behind them."""
    left = {c.lower(): (c, source) for c, source in own.items()}
    out = [F.col(left.pop(c.lower())[1]).alias(c) if c.lower() in left else F.col(row)[f"c{i}"].alias(c) for i, c in enumerate(columns)]
    return out + [F.col(source).alias(c) for c, source in left.values()]


def schema_of(df: DataFrame, **more) -> StructType:
    """The schema of ``df`` with further fields of the given types."""
    out = StructType(list(df.schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [start, stop) with their UTF-8 bytes and byte offsets, about ``limit``
    bytes at a time; a longer text is a block of its own. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], kind, n + at + 1)[at:].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop
