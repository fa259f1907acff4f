"""Exact top-k search by vector-approximation files.

Vectors are dealt into blocks of rows.  Phase 1 scans a block's approximation:
every component is quantised to one of ``2**cell_bits`` cells between the block's
least and greatest value, and the cells' edges bound every inner product from
below and above.  Phase 2 reads exact vectors in order of falling upper bounds
(the order of rising lower distance bounds) and stops for a query once its kth
best exact score exceeds every bound left; ties of the kth score are read too,
as the smaller id wins.  The query set meets every block, blocks of queries
against blocks of rows; the k best of each block are merged by a ranked window.

Scores are inner products of whole numbers and exact at every size: components are
doubles, which hold floor(scale * x) as it is; products are taken in doubles where
all of a block's sums stay below 2**53, else in 64-bit integers, else in Python's.
A score among the k best that a long can't hold is an error, never a wrong number.

Defined results: vectors that are null, empty, or hold null or non-finite components
take no part (nor do those whose component scales to infinity); neither do rows with
a null id; only vectors of one length are compared; rows that repeat an id are one
row each, but a query finds no row of its own id; fewer than k candidates give all;
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juriscope.llm.common import parts_for, quoted


def _blobs(rows: DataFrame, id_col: str, vector_col: str, scale: float, block_rows: int, blocks: int) -> DataFrame:
    """(dim, block, ids, vectors): blocks of at most ``block_rows`` integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        out = {"dim": [], "block": [], "ids": [], "vectors": []}

        def close(dim: int) -> None:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            out["dim"].append(dim)
            out["block"].append(crc32(ids.tobytes()) % blocks)
            out["ids"].append(ids.tobytes())
            out["vectors"].append(vectors.tobytes())

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                x = flat[first[mine][:, None] + np.arange(dim)]
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x.astype(np.float64))
                good = np.isfinite(x).all(axis=1)
                x = x[good]
                mine = mine[good]
                for i in range(0, len(mine), block_rows):
                    held.setdefault(dim, []).append((ids[mine[i : i + block_rows]].astype(np.int64), x[i : i + block_rows]))
                    if sum(len(a) for a, _ in held[dim]) >= block_rows:
                        close(dim)
        for dim in list(held):
            if sum(len(a) for a, _ in held[dim]):
                close(dim)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    whole = rows.select(F.col(quoted(id_col)).cast("long").alias("id"), F.transform(F.col(quoted(vector_col)), lambda x: x.cast("double")).alias("v"))
    whole = whole.filter("id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    return whole.mapInArrow(run, "dim int, block int, ids binary, vectors binary")


def approximate(rows: np.ndarray, cell_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the components and, for each dimension, the cells' lower and upper edges."""
    low, high = rows.min(axis=0), rows.max(axis=0)
    n = 1 << cell_bits
    width = np.maximum(high / n - low / n, 1.0) * (1 + 1e-9)
    with np.errstate(over="ignore", invalid="ignore"):
        cells = np.nan_to_num(np.clip((rows - low) // width, 0, n - 1)).astype(np.uint8)
        edges = low + np.arange(n)[:, None] * width
        wild = ~np.isfinite(high - low + width)
    if wild.any():  # beyond doubles: one cell without edges
        cells[:, wild] = 0
        return cells, np.where(wild, -np.inf, edges), np.where(wild, np.inf, edges + width)
    # Rounding of wide cells must not put a row outside of its own.
    slack = 1e-12 * np.maximum(np.abs(low), np.abs(high)) + 1e-9 * width
    return cells, edges - slack, edges + width + slack


def bounds(queries: np.ndarray, cells: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of queries x rows inner products from the cells alone; none
    (infinite ones) where they are beyond doubles, so that such rows are read."""
    at = np.arange(cells.shape[1])
    lo, hi = lower[cells, at], upper[cells, at]
    size = np.abs(queries)
    with np.errstate(over="ignore", invalid="ignore"):
        # Halves of the sums: middle and spread need one product each.
        middle, spread = queries @ ((lo + hi) / 2).T, size @ ((hi - lo) / 2).T
        # Rounding is in proportion to the terms, not to their sum.
        slack = 1e-15 * (len(at) + 4) * (size @ np.maximum(np.abs(lo), np.abs(hi)).T) + 1e-6
        low, high = middle - spread - slack, middle + spread + slack
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def exact_products(rows: np.ndarray, query: np.ndarray):
    """Exact inner products: doubles or 64-bit integers where they hold them, else Python's integers."""
    most = np.abs(rows).max(initial=0.0) * np.abs(query).max(initial=0.0) * rows.shape[1]
    if most < 1 << 53:
        return (rows @ query).astype(np.int64)
    if most < 1 << 62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    q = list(map(int, query))
    return np.array([sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in rows], object)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, cell_bits: int = 5, step: int = 64, known: list | None = None, built: tuple | None = None):
    """The k best (ids, scores) of each query among the block's rows and ``known``, those
    of earlier blocks, with the number of exact vectors read. ``built``: the block's cells
    and edges, where they are known."""
    cells, lower, upper = built or approximate(rows, cell_bits)
    low, high = bounds(queries, cells, lower, upper)
    own = query_ids[:, None] == ids[None, :]
    low[own] = high[own] = -np.inf
    n, reach = len(ids), min(k, len(ids))
    # No row whose upper bound is under the kth best lower bound can be among the k best.
    floor = -np.partition(-low, reach - 1, axis=1)[:, reach - 1] if reach == k else np.full(len(queries), -np.inf)
    best, read = known or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries), 0
    out = []
    for q in range(len(queries)):
        best_ids, scores = best[q]
        some = np.flatnonzero((high[q] >= floor[q]) & ~own[q])
        some = some[np.argsort(-high[q, some], kind="stable")]
        for i in range(0, len(some), step):
            if len(scores) == k and float(high[q, some[i]]) < int(scores[-1]):
                break
            part = some[i : i + step]
            read += len(part)
            scores = np.concatenate([scores, exact_products(rows[part], queries[q])])
            best_ids = np.concatenate([best_ids, ids[part]])
            order = np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], best_ids[j])), int)[:k] if scores.dtype == object else np.lexsort([best_ids, -scores])[:k]
            scores, best_ids = scores[order], best_ids[order]
        out.append((best_ids, scores))
    return out, read


def with_cells(blobs: DataFrame, cell_bits: int) -> DataFrame:
    """The approximation file: each block of rows with its cells and their edges, built once
    however many blocks of queries meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                dim, rows = batch.column(0)[i].as_py(), np.frombuffer(batch.column(3)[i].as_buffer(), np.float64)
                built = approximate(rows.reshape(-1, dim), cell_bits)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([x.tobytes()], pa.binary()) for x in built)], ["dim", "block", "row_ids", "row_vectors", "cells", "lower", "upper"])

    return blobs.mapInArrow(run, "dim int, block int, row_ids binary, row_vectors binary, cells binary, lower binary, upper binary")


#: Queries that one task holds.
TASK_QUERIES = 1 << 15


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int = 4096, query_rows: int = 512, cell_bits: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products among ``rows``."""
    blocks = parts_for(rows.count(), 16 * block_rows, least=32)
    shares = max(1, -(-queries.count() // TASK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A task joins one block number, which stands for many rows, with one share of the queries:
    # blocks of either are held one at a time, with the kth score so far.
    base = with_cells(_blobs(rows, id_col, vector_col, scale, block_rows, blocks), cell_bits).select("*", every(shares).alias("share"))
    asked = _blobs(queries, id_col, vector_col, scale, query_rows, blocks).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).drop("block").select("*", every(blocks).alias("block"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        files = []
        for i in range(len(left)):
            ids, vectors, cells, lower, upper = (left.column(c)[i].as_buffer() for c in ("row_ids", "row_vectors", "cells", "lower", "upper"))
            table = lambda b: np.frombuffer(b, np.float64).reshape(-1, dim)
            files.append((np.frombuffer(ids, np.int64), table(vectors), (np.frombuffer(cells, np.uint8).reshape(-1, dim), table(lower), table(upper))))
        for qi, qv in zip(right.column("ids"), right.column("vectors"), strict=True):
            q, qx, best = np.frombuffer(qi.as_buffer(), np.int64), np.frombuffer(qv.as_buffer(), np.float64).reshape(-1, dim), None
            for ids, vectors, built in files:
                best, _ = search_block(q, qx, ids, vectors, k, cell_bits, known=best, built=built)
            for one, (ids, scores) in zip(q, best or [], strict=False):
                held = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores], np.int64) if scores.dtype == object else scores
                out.append((np.full(len(ids), one), ids, held, (held != scores).astype(bool)))
        q, i, s, beyond = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        return pa.table({"query_id": q, "vec_id": i, "score": s, "beyond": beyond})

    near = base.groupBy("dim", "block", "share").cogroup(asked.groupBy("dim", "block", "share")).applyInArrow(run, "query_id long, vec_id long, score long, beyond boolean")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = F.when(F.col("beyond"), F.raise_error(F.concat(F.lit("a score does not fit 64 bits, query "), "query_id")).cast("long")).otherwise(F.col("score"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
