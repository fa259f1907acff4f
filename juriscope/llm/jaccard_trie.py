"""N-gram Jaccard join by prefix trees.

Sets: 64-bit hashes of a text's distinct windows of ``shingle`` words, ASCII letters in
lower case; a shorter text is one window.  The hash is the global order of n-grams.
Equal sets meet first, so copies cost one row.

Blocks: two sets of similarity P or more differ in at most d of their n + m elements,
(100 + P) d <= (100 - P)(n + m).  The hash space is cut into equal parts, more for larger
sets, and a set's part is what it holds of one.  Each element that differs spoils one part,
so of the parts of either at most d are not the other's; in a common order the first one
that both have is among the first d + 1 of both.  These are the keys by which sets meet,
d taken for the largest partner; the order puts parts of many elements first, which
hardly any other set has, whatever n-grams are frequent.  A set that fills no more than
d parts also takes part in a finer cut, at last in one by elements.  Sizes go by powers of
two; a set whose partner may be of a higher one takes part in that cut too.

Trie: the sets of a block are the paths of a prefix tree, stored as ranges of the sorted
sets with the length that each range shares.  A probe walks down from the root; the part
of a path is compared once for all sets below it, and the n-grams it shares with the
probe are carried on.  A subtree is left as soon as what is left of the probe or of the
longest set below can't reach P, or when all below is in the probe's component.

Rounds: first every set is joined in one block only, its largest; then components are
joined by one set each where a block was too large for a task; at last all sets of every
block that holds two components.  For that, blocks that share sets are one block as long
as it fits a task, so that a set is sent once and not with each of its parts.  A block of
more than ``TASK_ITEMS`` n-grams is cut into chunks by hash and its tasks are the pairs
of chunks.  Tasks return spanning forests.

Defined results: null and empty texts have an empty set and are linked with nothing;
rows that repeat an id each get their row; a null id gets its row and names no component
unless all of its component is null; an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juriscope.llm import hashing
from juriscope.llm.common import quoted, text_blocks, written
from juriscope.llm.hashing import mix
from juriscope.llm.simhash import contract, union

#: N-grams that one task holds of a block: 8 MB, some ten times that while it joins them.
TASK_ITEMS = 1 << 20
#: N-grams and probes that one numpy step compares.
STEP = 1 << 20


# ------------------------------------------------------------------------ sets
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of texts: their distinct shingles, each text's sorted, and the first of
    each text (with the number of all at the end)."""
    for start, stop, data, offsets in text_blocks(column):
        data = _LOWER[data]
        starts, stops, firsts = hashing.find_words(data, offsets)
        words = hashing.word_hashes(data, starts, stops) if len(starts) else np.zeros(0, np.uint64)
        grams = hashing.window_hashes(words, shingle)
        of = np.repeat(np.arange(stop - start), np.diff(firsts))
        inside = hashing.inside_texts(firsts, shingle, len(grams)) if len(grams) else np.zeros(0, bool)
        grams, of = grams[inside], of[: len(inside)][inside]
        n = np.diff(firsts)
        short = np.flatnonzero((n > 0) & (n < shingle))
        if len(short):
            whole = [hashing.window_hashes(words[firsts[i] : firsts[i + 1]], int(n[i]))[0] for i in short]
            grams, of = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([of, short])
        order = np.lexsort((grams, of))
        grams, of = grams[order], of[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        grams, of = grams[new], of[new]
        yield grams, np.searchsorted(of, np.arange(stop - start + 1))


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes())


# ---------------------------------------------------------------------- blocks
def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements sets of n may differ from any of similarity ``percent``."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


#: Which share of the parts of a cut is keys at most, and how often a cut is made finer
#: before single elements are taken.
SHARE, FINER = 0.75, 4


def parts(items: np.ndarray, firsts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the parts by which the sets ``items[firsts[i]:firsts[i + 1]]``, each
    sorted, meet."""
    n = np.diff(firsts)
    power = np.where(n > 0, np.frexp(n.astype(float))[1] - 1, 0)
    mixed = mix(items)
    jobs = []
    for up in range(64):
        reached = np.flatnonzero((n > 0) & ((1 << np.minimum(power + up, 62)) <= 100 * n // percent))
        if not len(reached):
            break
        # The parts of a set of twice the size, so that those of this size are no more.
        jobs.append((reached, np.maximum(1, np.ceil(most_apart(2 << (power[reached] + up), percent) / SHARE)).astype(np.int64)))
    if not jobs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of, cuts = (np.concatenate(x) for x in zip(*jobs, strict=True))
    apart = most_apart(n, percent)
    out_of, out_key = [], []
    for turn in range(FINER + 1):
        size = n[of]
        job = np.repeat(np.arange(len(of)), size)
        at = np.arange(len(job)) + np.repeat(firsts[:-1][of] - (np.cumsum(size) - size), size)
        if turn < FINER:
            part = (items[at] >> np.uint64(32)) * cuts[job].astype(np.uint64) >> np.uint64(32)
            new = np.ones(len(at), bool)
            new[1:] = (part[1:] != part[:-1]) | (job[1:] != job[:-1])
            take = apart[of] + 1
        else:
            new = np.ones(len(at), bool)
            take = size - (percent * size + 99) // 100 + 1
        start = np.flatnonzero(new)
        held = np.diff(np.append(start, len(at)))
        mine = job[start]
        key = mix(np.add.reduceat(mixed[at], start) + mix(cuts[mine].astype(np.uint64)) * np.uint64(2 * turn + 1))
        order = np.lexsort((key, -held, mine))
        filled = np.bincount(mine, minlength=len(of))
        place = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
        chosen = order[place < take[mine[order]]]
        out_of.append(of[mine[chosen]])
        out_key.append(key[chosen])
        few = filled <= apart[of]
        of, cuts = of[few], 2 * cuts[few]
        if not len(of):
            break
    return np.concatenate(out_of), np.concatenate(out_key)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def marks_of(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The columns of ``texts``, whose last is the text, without it and with sid, n and keys:
    the set of every row, its size and the keys of its parts."""
    kept = texts.columns[:-1]
    schema = ", ".join(f"{c} {t}" for c, t in texts.dtypes[:-1]) + ", sid long, n long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for items, firsts in shingle_sets(batch.column(len(kept)), shingle):
                n = np.diff(firsts)
                ids = np.array([set_id(items[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], np.uint64)
                of, keys = parts(items, firsts, percent)
                keys = keys[np.argsort(of, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _longs(keys))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(n)) for k in range(len(kept))), _longs(ids), pa.array(n), lists], [*kept, "sid", "n", "keys"])
                at += len(n)

    return texts.mapInArrow(run, schema)


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(sid, items): the n-grams of every row of ``texts`` (text), sorted, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items, firsts in shingle_sets(batch.column(0), shingle):
                cut = [items[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([_longs(np.array([set_id(x) for x in cut], np.uint64)), pa.array([x.tobytes() for x in cut], pa.binary())], ["sid", "items"])

    return texts.select("text").mapInArrow(run, "sid long, items binary")


# ------------------------------------------------------------------------ trie
class Trie:
    """The sorted sets of several blocks as prefix trees.  Node v is the range
    [low, high) of sets, which share their first ``depth`` n-grams; its children are the
    nodes [child, child + children).  The first ``roots`` nodes are the blocks."""

    def __init__(self, sets: list[np.ndarray], block: np.ndarray):
        """``sets`` in the order of (block, n-grams)."""
        self.size = np.array([len(x) for x in sets], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        found, dense = np.unique(np.concatenate(sets), return_inverse=True)
        self.span = len(found) + 1
        self.items = dense.astype(np.int64)
        #: Set and n-gram in one number, sorted: where a set's n-grams are looked up.
        self.keys = np.repeat(np.arange(len(sets)), self.size) * self.span + self.items
        shared = np.zeros(len(sets) + 1, np.int64)  # with the set before; -1 between blocks
        for i in range(1, len(sets)):
            n = min(self.size[i - 1], self.size[i])
            differ = self.items[self.first[i - 1] : self.first[i - 1] + n] != self.items[self.first[i] : self.first[i] + n]
            shared[i] = differ.argmax() if differ.any() else n
        shared[np.flatnonzero(np.diff(block)) + 1] = -1
        shared[0] = shared[-1] = -1
        low = np.flatnonzero(shared[:-1] < 0)
        high = np.append(low[1:], len(sets))
        self.roots = len(low)
        lows, highs, depths, child, children = [low], [high], [np.zeros(len(low), np.int64)], [], []
        total, depth = len(low), depths[0]
        while True:
            # A range is cut where neighbours share no more than the range does as a whole.
            wide = high - low > 1
            inner = np.flatnonzero(wide)
            n = (high - low - 1)[inner]
            at = np.arange(n.sum()) + np.repeat(low[inner] + 1 - (np.cumsum(n) - n), n)
            of = np.repeat(np.arange(len(inner)), n)
            least = np.minimum.reduceat(shared[at], np.cumsum(n) - n) if len(inner) else n
            depth[inner] = least  # what all sets below share
            cut = shared[at] == least[of]
            k = np.bincount(of[cut], minlength=len(inner)) + 1
            counts = np.zeros(len(low), np.int64)
            counts[inner] = k
            child.append(total + np.cumsum(counts) - counts)
            children.append(counts)
            depth[~wide] = self.size[low[~wide]]
            if not len(inner):
                break
            starts = np.sort(np.concatenate([low[inner], at[cut]]))
            owner = np.repeat(high[inner], k)
            after = np.append(starts[1:], 0)
            last = np.cumsum(k) - 1
            after[last] = owner[last]
            low, high = starts, after
            depth = np.zeros(len(low), np.int64)
            total += len(low)
            lows.append(low), highs.append(high), depths.append(depth)
        self.low, self.high, self.depth = (np.concatenate(x) for x in (lows, highs, depths))
        self.child, self.children = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (child, children))
        self.shortest, self.longest = self.ranges(self.size)

    def ranges(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest of ``values`` (one for each set) below every node."""
        at = np.stack([self.low, self.high], 1).ravel()
        padded = np.append(values, values[-1])
        return np.minimum.reduceat(padded, at)[::2], np.maximum.reduceat(padded, at)[::2]

    def shared(self, probe: np.ndarray, path: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams ``start`` to ``stop`` of set ``path`` the probe holds, and how
        many of the probe come before ``stop``'s."""
        n = stop - start
        out = np.zeros(len(n), np.int64)
        full = np.flatnonzero(n)
        at = np.arange(n.sum()) + np.repeat((self.first[path] + start)[full] - (np.cumsum(n) - n)[full], n[full])
        asked = np.repeat(probe[full], n[full]) * self.span + self.items[at]
        held = self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked
        if len(full):
            out[full] = np.add.reduceat(held, (np.cumsum(n) - n)[full], dtype=np.int64)
        last = probe * self.span + self.items[np.maximum(self.first[path] + stop - 1, 0)]
        before = np.searchsorted(self.keys, last, "right") - self.first[probe]
        return out, np.where(stop > 0, before, 0)

    def links(self, percent: int) -> np.ndarray:
        """The component of every set among those of its block: its least set."""
        found = np.arange(len(self.size))
        root = np.repeat(np.arange(self.roots), self.high[: self.roots] - self.low[: self.roots])
        place = np.arange(len(self.size)) - self.low[root]
        wave = 0
        while 2**wave - 1 <= place.max():
            # Few probes first: they link most of a group, whose inner pairs aren't compared then.
            probes = np.flatnonzero((place >= 2**wave - 1) & (place < 2 ** (wave + 1) - 1))
            for a in range(0, len(probes), 1 << 14):
                self._walk(probes[a : a + (1 << 14)], root, found, percent)
            wave += 1
        return found

    def _walk(self, probes: np.ndarray, root: np.ndarray, found: np.ndarray, percent: int) -> None:
        least, most = self.ranges(found)
        zeros = np.zeros(len(probes), np.int64)
        stack = [(probes, root[probes], zeros, zeros)]  # probe, node, shared so far, n-grams of the path so far
        while stack:
            i, v, both, d = stack.pop()
            todo = self.depth[v] - d
            step = np.minimum(todo, np.maximum(64, d))
            if len(i) > 1 and step.sum() > STEP:
                cut = max(1, min(len(i) - 1, int(np.searchsorted(np.cumsum(step), STEP))))
                stack += [(i[cut:], v[cut:], both[cut:], d[cut:]), (i[:cut], v[:cut], both[:cut], d[:cut])]
                continue
            more, before = self.shared(i, self.low[v], d, d + step)
            both, d = both + more, d + step
            n, p = self.size[i], percent
            live = (100 + p) * (both + self.longest[v] - d) >= p * (n + self.longest[v])
            live &= (100 + p) * (both + n - before) >= p * (n + self.shortest[v])
            live &= (self.high[v] > i + 1) & ~((least[v] == most[v]) & (least[v] == found[i]))
            i, v, both, d = i[live], v[live], both[live], d[live]
            over = d == self.depth[v]
            if not over.all():
                stack.append(tuple(x[~over] for x in (i, v, both, d)))
            leaf = over & (self.children[v] == 0)
            if leaf.any():
                a, b = i[leaf], self.low[v[leaf]]
                alike = (b > a) & ((100 + p) * both[leaf] >= p * (self.size[a] + self.size[b]))
                union(found, a[alike], b[alike])
            inner = np.flatnonzero(over & (self.children[v] > 0))
            block = max(1, STEP // 16)
            if len(inner):
                k = self.children[v[inner]]
                ends = np.cumsum(k)
                for a in range(0, int(ends[-1]), block):
                    z = np.arange(a, min(a + block, int(ends[-1])))
                    of = np.searchsorted(ends, z, "right")
                    w = inner[of]
                    c = self.child[v[w]] + z - (ends[of] - k[of])
                    keep = self.high[c] > i[w] + 1
                    stack.append((i[w][keep], c[keep], both[w][keep], d[w][keep]))


def _forest(rows: list[tuple[tuple, int, np.ndarray]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): for every block of ``rows`` (block, sid, n-grams) stars of its components."""
    rows.sort(key=lambda r: (r[0], r[2].astype(">u8").tobytes()))
    ids = np.array([r[1] for r in rows], np.int64)
    number: dict[tuple, int] = {}
    block = np.array([number.setdefault(r[0], len(number)) for r in rows])
    found = Trie([r[2] for r in rows], block).links(percent)
    away = found != np.arange(len(found))
    return ids[found[away]], ids[away]


def trie_join(placed: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that span the similar sets of each block of ``placed`` (block, a, b, sid,
    items): a and b number the chunks of the block's set and its partner."""
    dealt = placed.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, None

        def out() -> pa.RecordBatch:
            u, v = _forest(held, percent)
            held.clear()
            return pa.RecordBatch.from_arrays([_longs(u), _longs(v)], ["u", "v"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for *block, sid, items in zip(*columns, batch.column(4), strict=True):
                if tuple(block) != seen:
                    seen = tuple(block)
                    if n > TASK_ITEMS // 2:
                        yield out()
                        n = 0
                held.append((seen, sid, np.frombuffer(items.as_buffer(), np.uint64)))
                n += len(held[-1][2])
        if held:
            yield out()

    return dealt.select("block", "a", "b", "sid", "items").mapInArrow(run, "u long, v long")


# ---------------------------------------------------------------------- rounds
def at_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` (u, v) between the roots of their ends."""
    for side in ("u", "v"):
        links = links.join(roots.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    return links.filter("u <> v").select("u", "v")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (u, v) are added to the components of ``roots``: only
    links between components are contracted."""
    up = contract(at_roots(links, roots))
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(up.select("node", "root").join(roots.select("node"), "node", "left_anti")), "roots")


def similar(entries: DataFrame, sets: DataFrame, percent: int, known: DataFrame) -> DataFrame:
    """(node, root) of the sets that are linked to another; ``entries`` (block, sid, n)
    hold blocks of two sets and more, ``sets`` (sid, items) their n-grams, ``known`` (u, v)
    links that are found already."""
    sizes = entries.groupBy("block").agg(F.sum("n").alias("total"))
    large = written(sizes.filter(F.col("total") > TASK_ITEMS).select("block", F.ceil(F.col("total") / TASK_ITEMS).alias("chunks")), "large")
    any_large = not large.isEmpty()

    def placed(chosen: DataFrame, pairs: bool) -> DataFrame:
        if not any_large:
            cut = chosen.select("block", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "sid")
        else:
            own = F.pmod(F.xxhash64(F.lit("chunk"), "sid"), F.col("chunks"))
            spread = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.struct(F.least(j, own).alias("a"), F.greatest(j, own).alias("b"))) if pairs else F.array(F.struct(own.alias("a"), own.alias("b")))
            cut = chosen.join(large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
            cut = cut.select("block", "sid", F.explode(spread).alias("c")).select("block", "c.a", "c.b", "sid")
        return cut.join(sets, "sid")

    def apart(roots: DataFrame) -> DataFrame:
        """The entries of blocks that hold two components, each with its component."""
        named = entries.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        mixed = named.groupBy("block").agg((F.min("root") < F.max("root")).alias("mixed")).filter("mixed").select("block")
        return written(named.join(mixed, "block").select("block", "sid", "root", "n"), "apart")

    roots = contract(known)
    # Every set once, in its largest block.
    left = apart(roots)
    best = left.join(sizes, "block").groupBy("sid").agg(F.max(F.struct("total", "block"))["block"].alias("block"))
    roots = joined(roots, written(trie_join(placed(best.select("block", "sid"), False), percent), "links"))
    left = apart(roots)
    if any_large:
        # One set of each component, in the largest block that it shares with others.
        totals = left.groupBy("block").agg(F.sum("n").alias("total"))
        reps = left.join(totals, "block").groupBy("root").agg(F.max(F.struct("total", "block", "sid")).alias("r")).select("r.block", "r.sid")
        roots = joined(roots, written(trie_join(placed(reps, True), percent), "links"))
        left = apart(roots)
    # Blocks that share sets, as far as they fit a task together.
    hubs = left.groupBy("block").agg(F.min("sid").alias("u"))
    clusters = contract(left.join(hubs, "block").select("u", F.col("sid").alias("v")))
    of = written(left.join(clusters.withColumnRenamed("node", "sid").withColumnRenamed("root", "cluster"), "sid").select("block", "sid", "n", "cluster"), "clusters")
    members = of.select("cluster", "sid", "n").distinct()
    fits = written(members.groupBy("cluster").agg((F.sum("n") <= TASK_ITEMS).alias("fits")), "fits")
    together = members.join(fits.filter("fits"), "cluster").select(F.col("cluster").alias("block"), "sid")
    single = of.join(fits.filter("NOT fits"), "cluster").select("block", "sid")
    return joined(roots, written(trie_join(placed(together.unionByName(single), True), percent), "links"))


def components(texts: DataFrame, marks: DataFrame, shingle: int, percent: int, known: DataFrame) -> DataFrame:
    """(sid, component_id): the class of every set of ``marks``, named by the smallest doc_id;
    ``texts`` (doc_id, row, text) and ``marks`` (doc_id, row, sid, n, keys) have the same
    rows, ``known`` (u, v) are links between sets found elsewhere."""
    once = marks.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    met = once.select("sid", "n", F.explode("keys").alias("block")).repartition("block")
    # Two sets whose sizes differ too much aren't similar.
    near = (F.col("k") > 2) | (100 * F.col("least") >= percent * F.col("most"))
    shared = met.groupBy("block").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("most")).filter((F.col("k") > 1) & near).select("block")
    entries = written(met.join(shared, "block").select("block", "sid", "n"), "entries")
    codes = written(marks.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row")), "codes")
    # The text of one row of each set that meets another.
    asked = codes.join(entries.select("sid").distinct(), "sid", "left_semi").select("row")
    sets = written(sets_of(texts.join(asked, "row"), shingle).dropDuplicates(["sid"]), "sets", codec="uncompressed")
    roots = similar(entries, sets, percent, known)
    named = written(codes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return written(named.join(least, "root").select("sid", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each row's set and its class, named by
    the smallest doc_id reached over links of ``percent`` or more."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    text = F.col(quoted(text_col)).cast("string")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text")).select("doc_id", "row", "text")
    marks = written(marks_of(texts, shingle, percent), "marks")
    none = marks.select(F.col("sid").alias("u"), F.col("sid").alias("v")).limit(0)
    of = components(texts, marks, shingle, percent, none)
    found = marks.select("doc_id", "n", "sid").join(of, "sid", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
