"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of rising ids.  Every batch's distinct line keys are
merge-anti-joined with the runs written so far; keys that no run holds become a
new run, dealt out by key and sorted, that records the smallest document of
each key.  When a level has ``fan_in`` runs and batches are still to come, they are
compacted into one run of the next level and dropped.  Runs never share a key, so together they name each key's
owner, and a line stays only in its owner.  Runs are persisted on the executors' disks
only while batches are added (one that is lost is computed again); the owners are
written to the shared folder, in files by their size and not one for each part of a run.

Defined results: null and empty texts are one empty line; rows with a null id
pass unchanged and own no line; rows that repeat an id are one document, each
row keeping its own lines; an empty table gives an empty table; other columns pass
whatever their names, but for n_lines and n_dropped, which are replaced.  Texts may
have any length; nothing but one text's lines is held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from juriscope.llm.common import carried, quoted, restored, size_hint, written

_STRIP = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Bytes of line keys, as stored, for each part of a run and each file of owners.
PART_BYTES = 64 << 20


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, tid, pos, h1, h2): a 128-bit key of every line of ``min_chars`` code
    points or more, after stripping and lower-casing ASCII letters. tid, a hash of
    the text, tells rows of one id apart."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            ids, tids, pos, high, low = [], [], [], [], []
            for doc, tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, line in enumerate((text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")):
                    line = line.strip(_STRIP)
                    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
                        continue
                    h = digest(line.lower())
                    ids.append(doc)
                    tids.append(tid)
                    pos.append(i)
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tids, pa.int64()), pa.array(pos, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["doc_id", "tid", "pos", "h1", "h2"])

    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(keys, "doc_id long, tid long, pos int, h1 long, h2 long")


class LineRuns:
    """The runs: a list per level, each a persisted table (h1, h2, owner) in ``parts``
    partitions by hash, sorted within each."""

    def __init__(self, spark: SparkSession, parts: int, fan_in: int = 2):
        self.spark, self.parts, self.fan_in = spark, parts, fan_in
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, rows: DataFrame) -> DataFrame:
        run = rows.select(*KEY, "owner").repartition(self.parts, *KEY).sortWithinPartitions(*KEY).persist(StorageLevel.DISK_ONLY)
        run.count()
        return run

    def close(self) -> None:
        """Frees the runs' disk; what is asked of them afterwards is computed again."""
        for run in self.runs:
            run.unpersist()

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` whose key no run holds: one merge anti join for each run."""
        return reduce(lambda left, run: left.join(run.hint("merge"), KEY, "left_anti"), self.runs, keys)

    def add(self, keys: DataFrame, last: bool = False) -> None:
        """Adds a batch's own keys (h1, h2, owner; one row for each key) as a run. After the
        ``last`` batch nothing is compacted: no batch meets the runs, and ``owners`` reads all."""
        self.levels[0].append(self._write(self.unseen(keys)))
        for level in range(0 if last else len(self.levels)):
            if len(self.levels[level]) < self.fan_in:
                break
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(reduce(DataFrame.unionByName, full)))
            for run in full:
                run.unpersist()

    def owners(self) -> DataFrame:
        """All runs as one table."""
        return reduce(DataFrame.unionByName, self.runs)


def repeated_lines(lines: DataFrame, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """(doc_id, tid, pos) of the lines whose key a smaller document owns."""
    spark = lines.sparkSession
    cuts = lines.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).head()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_hint(lines) // PART_BYTES)
    runs = LineRuns(spark, parts, fan_in)
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            batch = lines if low is None else lines.filter(F.col("doc_id") > low)
            batch = batch if high is None else batch.filter(F.col("doc_id") <= high)
            runs.add(batch.groupBy(*KEY).agg(F.min("doc_id").alias("owner")), last=high is None)
        owners = runs.owners()
        # As files they are not dealt out by key: a join that deals out both sides lets
        # Spark split the rows of a very common line.
        files = max(spark.sparkContext.defaultParallelism, size_hint(owners) // PART_BYTES)
        owners = written(owners.coalesce(files), "line-owners", "lz4")
    finally:
        runs.close()
    return lines.join(owners, KEY).filter("doc_id <> owner").select("doc_id", "tid", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``; adds (or replaces)
    n_lines, the lines before, and n_dropped."""
    lines = written(line_keys(docs, id_col, text_col, min_chars), "lines")
    gone = repeated_lines(lines, batches, fan_in).groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    text = F.col(quoted(text_col)).cast("string")
    taken = docs.select(carried(docs).alias("row"), F.coalesce(text, F.lit("")).alias("text"), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"))
    taken = taken.join(gone, ["doc_id", "tid"], "left").withColumn("lines", F.split("text", "\n"))
    # One character for each line, 1 for a line that goes: found by index, not by search.
    gaps = F.transform("gone", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i == 0, -1).otherwise(F.get("gone", i - 1)) - 1), F.lit("1")))
    taken = taken.withColumn("flags", F.when(F.col("gone").isNull(), F.lit(None)).otherwise(F.split(F.array_join(gaps, ""), "")))
    left = F.array_join(F.filter("lines", lambda line, i: F.coalesce(F.get("flags", i), F.lit("0")) != "1"), "\n")
    taken = taken.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    taken = taken.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dropped", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"))
    return taken.select(*restored(docs.columns, "row", **{text_col: "left"}, n_lines="n_lines", n_dropped="n_dropped"))
