"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: a bit is 1 if set in over half of the XXH64 hashes (seed 42) of a
text's word shingles.  Equal fingerprints meet first, so copies cost one row.

Join: two fingerprints link at ``bits`` or fewer differing bits.  A trie over the
sorted fingerprints is walked in node pairs from the root; differing bits add up
on the way down and a pair is pruned once they exceed the budget of its depth.
The budget grows with the depth: the 64 bits are ``bits`` blocks, the trie is built once from
each block on (the fingerprint rotated), and after j blocks at most j errors are
allowed.  No link is lost by that, as ``bits`` errors dealt over ``bits`` blocks
average one a block, and then some rotation never runs ahead of its average
(the cycle lemma).  Tasks are node pairs at a depth that follows the number of
fingerprints; a node of more than ``task_codes`` fingerprints is cut into chunks by
hash, and its tasks are the pairs of chunks.  A task returns a spanning forest of its
links.

Components: edges are contracted, each node to the best of its neighbourhood, by turns
the least and the first by a hash that changes each round, until none is left; every
step is a join.

Defined results: null and empty texts have fingerprint zero, linked like any
other; texts shorter than a shingle count as one shingle; rows that repeat an id
each get their row; a null id gets a fingerprint and names no component unless
all of its component is null; an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.llm.common import quoted, written


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: bytes, shingle: int = 4, seed: int = 42) -> list[int]:
    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    stops = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], seed) for i, j in zip([0, *[s + 1 for s in stops[: -shingle]]], stops[shingle - 1 :], strict=True)]


def majority(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Fingerprints of groups of ``hashes``; ``firsts`` holds each group's first and the end."""
    out = np.zeros(len(firsts) - 1, np.uint64)
    full = np.flatnonzero(np.diff(firsts))
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, firsts[full], axis=0, dtype=np.int32)
        more = 2 * ones > np.diff(firsts)[full, None]
        out[full] = np.packbits(more, axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, hashes, firsts = [], [], [0]

            def flush():
                out.append(majority(np.array(hashes, np.uint64), np.array(firsts)))
                hashes.clear()
                firsts[:] = [0]

            for text in batch.column(1):
                hashes += shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle, seed)
                firsts.append(len(hashes))
                if len(hashes) > 1 << 17:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------- trie join
def budgets(bits: int) -> np.ndarray:
    """Errors allowed after each of 0 to 64 bits of a rotated fingerprint."""
    ends = [64 * j // max(bits, 1) for j in range(1, max(bits, 1) + 1)]
    return np.array([next((j + 1 for j, end in enumerate(ends) if d <= end), bits) if bits else 0 for d in range(65)])


def _halves(codes: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where bit ``depth`` turns from 0 to 1 in each node, a range of the sorted codes."""
    bit = np.uint64(1 << (63 - depth))
    keep = np.uint64(((1 << 64) - 1) & ~((1 << (64 - depth)) - 1))
    return np.clip(np.searchsorted(codes, (codes[low] & keep) | bit), low, high)


def trie_pairs(a: np.ndarray, b: np.ndarray | None, bits: int, depth: int = 0, small: int = 32, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j) with at most ``bits`` differing bits between the
    sorted, distinct codes ``a`` and ``b`` (None: between a and itself, i < j), found
    by walking their tries in node pairs. All codes of a (and of b) agree in their
    first ``depth`` bits."""
    allowed = budgets(bits)
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    start = int(a[0] ^ b[0]) >> (64 - depth) if depth else 0
    first = [np.array([x]) for x in (0, len(a), 0, len(b), start.bit_count())]
    stack = [(depth, first)] if start.bit_count() <= allowed[depth] else []
    while stack:
        depth, nodes = stack.pop()
        if len(nodes[0]) > block:
            stack += [(depth, [x[i : i + block] for x in nodes]) for i in range(0, len(nodes[0]), block)]
            continue
        al, ah, bl, bh, wrong = nodes
        done = ((ah - al) * (bh - bl) <= small) | (depth == 64)
        if done.any():  # few enough to compare one by one
            yield from _compare(a, b, al[done], ah[done], bl[done], bh[done], bits, own)
            al, ah, bl, bh, wrong = (x[~done] for x in nodes)
        if not len(al):
            continue
        am, bm = _halves(a, al, ah, depth), _halves(b, bl, bh, depth)
        same = (al == bl) & own
        parts = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            part = [am if x else al, ah if x else am, bm if y else bl, bh if y else bm, wrong + (x != y)]
            keep = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= allowed[depth + 1])
            if (x, y) == (1, 0):
                keep &= ~same
            parts.append([p[keep] for p in part])
        stack.append((depth + 1, [np.concatenate(p) for p in zip(*parts, strict=True)]))


def _compare(a, b, al, ah, bl, bh, bits, own, most: int = 1 << 21):
    sizes = (ah - al) * (bh - bl)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = sizes[at:stop]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat((bh - bl)[at:stop], n)
        i, j = np.repeat(al[at:stop], n) + k // width, np.repeat(bl[at:stop], n) + k % width
        keep = np.bitwise_count(a[i] ^ b[j]) <= bits
        if own:
            keep &= i < j
        yield i[keep], j[keep]
        at = stop


def union(roots: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merges the sets of u and v; ``roots`` names each node's smallest member."""
    while True:
        x, y = roots[u], roots[v]
        apart = x != y
        if not apart.any():
            return
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots[:] = up


def rotate(x, by: int):
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def links(codes: DataFrame, bits: int = 4, task_codes: int = 20_000) -> DataFrame:
    """(u, v): a spanning forest of the links between the distinct longs ``codes.fp``."""
    n = max(1, codes.count())
    depth = min(64 // max(bits, 1), 20, max(4, (n // task_codes).bit_length()))
    turns = [64 * j // bits for j in range(bits)] if bits else []

    def prefix(turn: int) -> tuple[Column, Column]:
        x = F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))
        return x, F.shiftrightunsigned(x, 64 - depth)

    keys = []
    for r, turn in enumerate(turns):
        x, p = prefix(turn)
        for bit in range(-1, depth):  # the node with itself, and with each that differs in one bit
            q = p if bit < 0 else p.bitwiseXOR(F.lit(1 << bit))
            keys.append(F.struct(F.lit(r).alias("r"), F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), x.alias("x")))
    if not keys:
        return codes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    dealt = codes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    own = F.shiftrightunsigned("x", 64 - depth)
    sizes = codes.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), prefix(turn)[1].alias("p")) for r, turn in enumerate(turns)])).alias("k")).groupBy("k.r", "k.p").agg(F.count("*").alias("n")).filter(F.col("n") > task_codes)
    large = written(sizes.select("r", "p", F.ceil(F.col("n") / task_codes).alias("n")), "large")
    if large.isEmpty():
        dealt = dealt.select("r", "a", "b", F.lit(0).alias("i"), F.lit(0).alias("j"), "x")
    else:
        for side in ("a", "b"):
            cut = large.select("r", F.col("p").alias(side), F.col("n").alias(f"n_{side}"))
            dealt = dealt.join(cut, ["r", side], "left").withColumn(f"n_{side}", F.coalesce(f"n_{side}", F.lit(1)))
        # A code's chunk of its own node meets every chunk of the other.
        chunk = lambda n: F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col(n))
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        first = F.transform(every("n_b"), lambda j: F.struct(chunk("n_a").alias("i"), j.alias("j")))
        second = F.transform(every("n_a"), lambda i: F.struct(i.alias("i"), chunk("n_b").alias("j")))
        within = F.transform(every("n_a"), lambda j: F.struct(F.least(chunk("n_a"), j).alias("i"), F.greatest(chunk("n_a"), j).alias("j")))
        pairs = F.when(F.col("a") == F.col("b"), within).when(own == F.col("a"), first).otherwise(second)
        dealt = dealt.select("r", "a", "b", F.explode(pairs).alias("c"), "x").select("r", "a", "b", "c.i", "c.j", "x")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        r, first, second = (k.as_py() for k in key[:3])
        x = np.sort(table.column("x").to_numpy().astype(np.int64).view(np.uint64))
        side = x >> np.uint64(64 - depth)
        # Two chunks of one node are walked as their union.
        a, b = x[side == first], x[side == second] if first != second else None
        whole = a if b is None else np.concatenate([a, b])
        roots = np.arange(len(whole))
        for i, j in trie_pairs(a, b, bits, depth):
            union(roots, i, j if b is None else j + len(a))
        # A star around the least code of each component.
        out = rotate(whole, (64 - turns[r]) % 64).view(np.int64)
        hub = out.copy()
        np.minimum.at(hub, roots, out)
        hub = hub[roots]
        away = hub != out
        return pa.table({"u": hub[away], "v": out[away]})

    return dealt.groupBy("r", "a", "b", "i", "j").applyInArrow(join, "u long, v long")


# ------------------------------------------------------------------ components
#: Edges that one task contracts by itself: 16 bytes each, so a few MB; more are shuffled.
TASK_EDGES = 200_000


def contract(edges: DataFrame) -> DataFrame:
    """(node, root): a common root for the nodes of every connected component. Every round
    merges at least the neighbours of the node that ranks first, so no edge is left at last.
    Even rounds rank nodes by themselves, which ends a star around its least node at once, odd
    ones by a hash, which shortens paths of any order."""
    pair = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    edges = written(edges.select(*pair("u", "v")).filter("u <> v").distinct(), "edges")
    maps: list[DataFrame] = []
    for k in count():
        n = edges.count()
        if maps and not n:
            break
        # Few edges are one partition, whose round needs no shuffle.
        edges = edges.coalesce(1) if n <= TASK_EDGES else edges
        rank = lambda c: F.struct((F.xxhash64(F.lit(k), c) if k % 2 else c).alias("rank"), c.alias("to"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best"))
        to = written(best.select(F.col("u").alias("node"), F.least(F.col("best"), rank(F.col("u")))["to"].alias("to")), "map")
        maps.append(to.coalesce(1) if n <= TASK_EDGES else to)
        at = lambda c: maps[-1].select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        moved = edges.join(at("u"), "u").join(at("v"), "v").filter("to_u <> to_v")
        edges = written(moved.select(*pair("to_u", "to_v")).distinct(), "edges")
    higher = lambda low, up: low.join(up.select(F.col("node").alias("to"), F.col("to").alias("top")), "to", "left").select("node", F.coalesce("top", "to").alias("to"))
    return reduce(lambda up, low: written(higher(low, up), "roots"), maps[::-1][1:], maps[-1]).withColumnRenamed("to", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): the class of each row, named by its smallest doc_id."""
    marks = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    codes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "codes")
    roots = contract(links(codes, bits))
    named = written(codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "named")
    least = written(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    of = written(named.join(least, "root").select("fp", "component_id"), "components")
    return marks.join(of, "fp").select("doc_id", "fp", "component_id")
