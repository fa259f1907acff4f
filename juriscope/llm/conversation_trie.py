"""Conversation prefix trie: which conversations start with the same turns, and what
storing every shared prefix once would save.

Nodes: the root, and one node for each distinct sequence of first turns (role, text); a
node's key is a chained 128-bit digest of its turns.  Its members are the conversations
that start with it.

Partial tries: every partition walks its conversations and keeps a table of nodes (least
member, number of members, bytes of the last text), which it emits whenever it is large.
The tables merge by key, first within shards of partitions, then whole, so that a node
that a third of all conversations pass is a few rows by the time it meets itself.  Ends
(the conversations that stop at a node) are rows of their own and merge by a sort; their
digest streams over it.

Rollup: nodes with the same least member lie on one line, as whoever is the least at a
node is so further down its own path.  Lines hang on nodes of other lines; totals of
lines go up that much lower tree by doubling (each line adds what hangs below the
ancestor 1, 2, 4, ... lines up), and a running sum from the bottom of each line gives
every node its subtree.

Defined results: null roles and texts are empty; turns without a number come first, turns
of one number in the order of role and text; repeated rows are turns of their own; rows
without a conversation belong to none and are left out; an empty table has no node; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juriscope.llm.common import written

ROOT = bytes(16)
#: Nodes and ends of a partition's table before it is emitted.
TABLE_NODES = 50_000
#: Shards of the first merge.
SHARDS = 16
#: Conversations of a group share turns of its head, at most this many.
GROUP, SHARED = 5, 8


def step(key: bytes, role: str, text: str) -> bytes:
    """The key of a node's child by the turn that leads to it."""
    a, b = role.encode(), text.encode()
    return hashlib.blake2b(key + len(a).to_bytes(8, "little") + a + b, digest_size=16).digest()


_NODE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("bytes", pa.int64()), ("ends", pa.list_(pa.int64()))])


class Partial:
    """A partition's table of nodes: key -> parent, depth, least member, members, bytes, ends."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.n_ends = 0

    def visit(self, key: bytes, parent: bytes | None, depth: int, conv_id: int, size: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [parent, depth, conv_id, 1, size, []]
        else:
            node[2] = min(node[2], conv_id)
            node[3] += 1

    def end(self, key: bytes, conv_id: int) -> None:
        self.nodes[key][5].append(conv_id)
        self.n_ends += 1

    def size(self) -> int:
        return len(self.nodes) + self.n_ends

    def table(self) -> pa.RecordBatch:
        columns = list(zip(*((k, *v) for k, v in self.nodes.items()), strict=True)) or [[]] * 7
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text) in partitions that hold each conversation's turns in a row:
    every conversation starts with the first h turns of its group's head (h by a hash of
    its id), then has its own after its first h. A row whose role is null ends one."""
    own = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.col("conv_id") - F.col("conv_id") % GROUP
    own = own.withColumns({"head": head, "h": F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)})
    # A group's head goes first.
    dealt = own.repartition("head").sortWithinPartitions("head", F.col("conv_id") != F.col("head"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, first, place = None, None, [], 0

        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text, head, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != now:
                    if now is not None:
                        out.append((now, None, None))
                    if head != group:
                        group, first = head, []
                    now, place = conv_id, 0
                    if conv_id != head:
                        out += [(conv_id, *turn) for turn in first[:h]]
                if conv_id == head:
                    if place < SHARED:
                        first.append((role, text))
                    out.append((conv_id, role, text))
                elif place >= h:
                    out.append((conv_id, role, text))
                place += 1
            yield _turns(out)
        if now is not None:
            yield _turns([(now, None, None)])

    return dealt.select("conv_id", "role", "text", "head", "h").mapInArrow(run, "conv_id long, role string, text string")


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "role", "text"])


def partial_tries(turns: DataFrame, table_nodes: int = TABLE_NODES) -> DataFrame:
    """(key, parent, depth, conv_id, n_convs, bytes, ends): the node tables of all partitions
    of ``turns`` (conv_id, role, text, each conversation in a row and ended by a null role)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, now, key, depth = Partial(), None, ROOT, 0
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None:
                    now, key, depth = conv_id, ROOT, 0
                    found.visit(ROOT, None, 0, conv_id, 0)
                if role is None:
                    if key not in found.nodes:  # emitted meanwhile
                        found.nodes[key] = [parent if depth else None, depth, conv_id, 0, size if depth else 0, []]
                    found.end(key, conv_id)
                    now = None
                else:
                    parent, key, depth, size = key, step(key, role, text), depth + 1, len(text.encode())
                    found.visit(key, parent, depth, conv_id, size)
                if found.size() >= table_nodes:
                    yield found.table()
        if found.nodes:
            yield found.table()

    return turns.select("conv_id", "role", "text").mapInArrow(run, "key binary, parent binary, depth long, conv_id long, n_convs long, bytes long, ends array<long>")


def merged(tables: DataFrame) -> DataFrame:
    """The node tables as one: members add up, first within shards."""
    add = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("bytes").alias("bytes")]
    part = tables.withColumn("shard", F.spark_partition_id() % SHARDS)
    return part.groupBy("key", "shard").agg(*add).groupBy("key").agg(*add)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of ``ends`` (key, conv_id), ascending and joined
    by commas."""
    dealt = ends.repartition("key").sortWithinPartitions("key", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for key, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(f",{conv_id}".encode())
            yield _digests(out)
        if now is not None:
            yield _digests([(now, digest.hexdigest())])

    return dealt.select("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.string())], ["key", "ends_sha256"])


def line_totals(lines: DataFrame) -> DataFrame:
    """(line, saved, leaves) of every line with all that hangs below it; ``lines`` (line, up,
    saved, leaves), where ``up`` is null at the top."""
    now = written(lines, "lines")
    while not now.filter("up IS NOT NULL").isEmpty():
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("line")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        above = now.filter("up IS NOT NULL").select(F.col("line").alias("up"), F.col("up").alias("higher"))
        moved = now.join(below, "line", "left").join(above, "up", "left")
        now = written(moved.select("line", F.col("higher").alias("up"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")), "lines")
    return now.select("line", "saved", "leaves")


def trie(turns: DataFrame, table_nodes: int = TABLE_NODES) -> DataFrame:
    """One row for each node of the prefix trie of ``turns`` (as ``rebuilt`` returns them):
    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    tables = written(partial_tries(turns, table_nodes), "tables")
    nodes = written(merged(tables.drop("ends")), "nodes")
    digests = ends_digest(tables.select("key", F.explode("ends").alias("conv_id")))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    # The top node of each line, and the node that it hangs on.
    tops = nodes.groupBy("conv_id").agg(F.min_by("parent", "depth").alias("key"), F.min("depth").alias("depth"), F.max("depth").alias("bottom"), F.sum("own").alias("own"))
    hung = written(tops.join(nodes.select("key", F.col("conv_id").alias("up")), "key", "left").select(F.col("conv_id").alias("line"), "up", (F.col("depth") - 1).alias("at"), "bottom", "own"), "hung")
    # A line's bottom is a leaf unless another line hangs on it.
    carries = hung.filter("up IS NOT NULL").select(F.col("up").alias("line"), F.col("at").alias("bottom")).distinct().withColumn("carries", F.lit(True))
    lines = hung.join(carries, ["line", "bottom"], "left").select("line", "up", "at", F.col("own").alias("saved"), F.when(F.col("carries"), 0).otherwise(1).cast("long").alias("leaves"))
    lines = written(lines, "lines")
    totals = line_totals(lines.select("line", "up", "saved", "leaves"))
    below = lines.filter("up IS NOT NULL").select("line", "up", "at").join(totals, "line")
    below = below.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("n_hung"), F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    ends = lines.select(F.col("line").alias("conv_id"), F.col("leaves").alias("end_leaf"), "up")
    bottoms = hung.select(F.col("line").alias("conv_id"), "bottom", (F.col("at") + 1).alias("top"))
    rows = nodes.join(below, ["conv_id", "depth"], "left").join(ends.join(bottoms, "conv_id"), "conv_id").join(digests, "key", "left")
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("long")
    return rows.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("n_hung", none) + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"),
        (F.col("end_leaf") + F.sum(F.coalesce("l", none)).over(upward)).alias("n_leaves"),
        F.sum(F.col("own") + F.coalesce("s", none)).over(upward).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
