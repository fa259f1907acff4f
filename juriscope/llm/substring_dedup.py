"""Substring dedup by level-wise doubling of repeated word windows.

Levels are window lengths, each at most twice the one before: 4, 7 and 13 words
for windows of 13.  A level looks at the windows that are left and sends, of each,
the ``length``-word window with the least hash that it holds: equal windows have
equal ones, and at the first level only one word place in six is sent.  Windows
whose one is in a single document go; those repeated are extended to the next
length, hashed anew and looked up again, until no candidates survive: a part of
the documents without one is done at once.  ``window`` is the last level, as a
repeat of any greater length is made of repeated windows of this one and could
take out no further word.

Layout: documents are dealt by id and text into parts of bounded size, as many as
the input asks for.  Within a part every distinct hash counts once, with its smallest
document; a level sends those hashes, packed by bucket, to the bucket's task and gets
back the ones that other parts hold too, at the last level with the smallest document
of all.  A window in a third of all documents therefore is one row of each part.  A
row holds the hashes of one part and bucket; there are never more rows than hashes.
Texts are shuffled once; all levels read that exchange.  Nothing is collected to the
driver.

Defined results: null and empty texts have no words and become empty; a text
shorter than a window loses nothing; rows that repeat an id are one document and
don't take words from each other; rows with a null id pass whole (their words
joined by one space) and take nothing from others; an empty table gives an empty
table; other columns pass whatever their names, but for n_words, n_removed and
spans, which are replaced.  Hashes have 64 bits at all levels but the last, where a
collision costs only time, and 96 bits at the last; words enter whole or by a digest
of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from juriscope.llm.common import carried, parts_for, quoted, restored, schema_of, text_blocks, text_bytes
from juriscope.llm.hashing import find_words, inside_texts, window_hashes, word_hashes

#: Bytes of text of a part; a bucket's task sorts about as many bytes of packed hashes.
PART_BYTES = 3 << 20
NO_DOC = np.int64(2**63 - 1)


def levels(window: int, least: int = 4) -> list[int]:
    """The lengths up to ``window``, each at most twice the one before, the first about ``least``."""
    out = [window]
    while out[0] > least:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Windows:
    """The windows of one block of texts: where they start, in which document."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, (self.starts, self.stops, self.firsts) = data, find_words(data, offsets)
        self.window = window
        self.words = word_hashes(data, self.starts, self.stops)
        self.at = np.flatnonzero(inside_texts(self.firsts, window, max(0, len(self.starts) - window + 1)))
        text = np.repeat(np.arange(len(ids)), np.diff(self.firsts))
        self.doc = ids[text[self.at]]
        self.at, self.doc = self.at[self.doc != NO_DOC], self.doc[self.doc != NO_DOC]

    def seeds(self, length: int, keep: np.ndarray | None = None) -> np.ndarray:
        """Of every window (or those at ``keep``) the least hash of ``length`` words in it."""
        least, n = window_hashes(self.words, length), 1
        run = self.window - length + 1
        while n < run:
            step = min(n, run - n)
            least, n = np.minimum(least[: len(least) - step], least[step:]), n + step
        return least[self.at if keep is None else self.at[keep]]

    def hashes(self, length: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the windows at ``self.at[keep]``, of ``length`` words."""
        if not len(keep):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        other = word_hashes(self.data, self.starts, self.stops, 1)
        at = self.at[keep]
        return window_hashes(self.words, length)[at], (window_hashes(other, length, 1)[at] >> np.uint64(32)).astype(np.uint32)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(int(NO_DOC)).to_numpy().astype(np.int64)


def _blocks(table: pa.Table, window: int) -> Iterator[tuple[int, int, Windows]]:
    ids = _ids(table.column("_id"))
    for start, stop, data, offsets in text_blocks(table.column("_text")):
        yield start, stop, Windows(ids[start:stop], data, offsets, window)


def _owners(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal keys: index of one, their smallest document, and whether
    there are two documents or more."""
    order = np.lexsort([doc, *keys[::-1]])
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return order, doc, new
    last = np.append(first[1:], len(doc)) - 1
    return order[first], doc[order][first], doc[order][last] > doc[order][first]


def _grouped(name: str, group: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each group, with the bytes of the columns' values there."""
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.diff(group[order], prepend=-1))
    ends = np.append(edges[1:], len(order))[: len(edges)].tolist()
    out = {name: group[order][edges]}
    for column, x in columns.items():
        raw, width = x[order].tobytes(), x.dtype.itemsize
        out[column] = pa.array([raw[a * width : b * width] for a, b in zip(edges.tolist(), ends, strict=True)], pa.binary())
    return pa.table(out)


def _packed(part: int, buckets: int, by: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each bucket that the keys fall into."""
    out = _grouped("bucket", (by % np.uint64(buckets)).astype(np.int64), **columns)
    return out.add_column(1, "part", pa.array(np.full(len(out), part, np.int64)))


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _seeds_of(seeds: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seeds of a part, sorted, and whether they have two documents or more."""
    first = []
    for x, doc in zip(seeds, docs, strict=True):
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
        first.append(new)
    found = np.concatenate([np.zeros(0, np.uint64), *[x[new] for x, new in zip(seeds, first, strict=True)]])
    doc = np.concatenate([np.zeros(0, np.int64), *[x[new] for x, new in zip(docs, first, strict=True)]])
    one, _, many = _owners([found], doc)
    return found[one], many


def _kept(blocks: list[Windows], length: int, survivors: np.ndarray) -> list[np.ndarray]:
    """Which windows of each block are repeated at ``length``: in another part, as the
    sorted ``survivors`` tell, or in two documents of this one."""
    seeds = [w.seeds(length) for w in blocks]
    found, many = _seeds_of(seeds, [w.doc for w in blocks])
    alive = np.union1d(found[many], survivors)
    return [np.flatnonzero(_found(alive, x)[1]) for x in seeds]


def _candidates(blocks: list[Windows], kept: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and documents of the windows at ``kept``."""
    hashes = [w.hashes(length, k) for w, k in zip(blocks, kept, strict=True)]
    high = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in hashes]])
    low = np.concatenate([np.zeros(0, np.uint32), *[h for _, h in hashes]])
    return high, low, np.concatenate([np.zeros(0, np.int64), *[w.doc[k] for w, k in zip(blocks, kept, strict=True)]])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, least: int = 4) -> DataFrame:
    """``docs`` with every word taken out of ``text_col`` that a window covers whose
    words also start in a document of a smaller id; the words left are joined by one
    space. Adds (or replaces) n_words, n_removed and spans, the words [start, stop)
    that went. The first level has windows of about ``least`` words."""
    key, text = F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string")
    parts = parts_for(text_bytes(docs, text), PART_BYTES)
    place = F.pmod(F.xxhash64(key, text), F.lit(parts)).cast("int")
    # The text travels by itself, not in the row.
    rest = docs.withColumn(text_col, F.lit(None).cast("string"))
    dealt = docs.select(place.alias("_part"), key.cast("long").alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), carried(rest).alias("_row"))
    span_type = "array<struct<start:int,stop:int>>"
    result = schema_of(dealt.select("_row", "_text"), n_words="long", n_removed="long", spans=StructType.fromDDL(f"x {span_type}")["x"].dataType)

    def first(key: tuple, table: pa.Table) -> pa.Table:
        blocks = [w for _, _, w in _blocks(table, window)]
        found, _ = _seeds_of([w.seeds(lengths[0]) for w in blocks], [w.doc for w in blocks])
        return _packed(key[0].as_py(), parts, found, key=found)

    def extended(shorter: int, length: int):
        """From what is repeated at one length to the seeds of the next."""

        def run(key: tuple, table: pa.Table, survivors: pa.Table) -> pa.Table:
            blocks = [w for _, _, w in _blocks(table, window)]
            kept = _kept(blocks, shorter, np.sort(_joined(survivors.column("key"), np.uint64)))
            full = [(w, k) for w, k in zip(blocks, kept, strict=True) if len(k)]
            found, _ = _seeds_of([w.seeds(length, k) for w, k in full], [w.doc[k] for w, k in full])
            return _packed(key[0].as_py(), parts, found, key=found)

        return run

    def shared_seeds(key: tuple, table: pa.Table) -> pa.Table:
        """Seeds of a bucket that two parts or more hold, for each of those parts."""
        part = np.repeat(table.column("part").to_numpy(), [len(x) // 8 for x in table.column("key").to_pylist()])
        found = _joined(table.column("key"), np.uint64)
        order = np.argsort(found, kind="stable")
        found, part = found[order], part[order]
        twice = np.zeros(len(found), bool)
        twice[1:] = found[1:] == found[:-1]
        twice[:-1] |= twice[1:]
        return _grouped("part", part[twice], key=found[twice])

    def windows(key: tuple, table: pa.Table, survivors: pa.Table) -> pa.Table:
        blocks = [w for _, _, w in _blocks(table, window)]
        kept = _kept(blocks, lengths[-1], np.sort(_joined(survivors.column("key"), np.uint64)))
        high, low, doc = _candidates(blocks, kept, window)
        one, owner, _ = _owners([high, low], doc)
        return _packed(key[0].as_py(), parts, high[one], high=high[one], low=low[one], doc=owner)

    def owners(key: tuple, table: pa.Table) -> pa.Table:
        """For each part that holds a window of a smaller document of another part: its hash and that document."""
        part = np.repeat(table.column("part").to_numpy(), [len(x) // 8 for x in table.column("high").to_pylist()])
        high, low, doc = (_joined(table.column(c), k) for c, k in (("high", np.uint64), ("low", np.uint32), ("doc", np.int64)))
        order = np.lexsort([doc, low, high])
        high, low, doc, part = high[order], low[order], doc[order], part[order]
        first = np.ones(len(high), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        owner = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        less = owner < doc
        return _grouped("part", part[less], high=high[less], low=low[less], doc=owner[less])

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        survivors, replies = (replies.filter(pyarrow.compute.is_valid(replies.column(c))) for c in ("key", "high"))
        blocks = list(_blocks(table, window))
        kept = _kept([w for _, _, w in blocks], lengths[-1], np.sort(_joined(survivors.column("key"), np.uint64)))
        high, low, doc = _candidates([w for _, _, w in blocks], kept, window)
        far = [_joined(replies.column(c), k) for c, k in (("high", np.uint64), ("low", np.uint32), ("doc", np.int64))]
        order = np.lexsort([doc, low, high])
        one, least, _ = _owners([np.concatenate([high, far[0]]), np.concatenate([low, far[1]])], np.concatenate([doc, far[2]]))
        known = [np.concatenate([high, far[0]])[one], np.concatenate([low, far[1]])[one]]
        # Equal windows stand together in both orders, so their ranks agree.
        rank = np.zeros(len(high), np.int64)
        hs, ls = high[order], low[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])
        # Replies name windows of this part only, so both lists hold the same windows.
        rank[order] = np.cumsum(new) - 1
        assert len(known[0]) == int(new.sum())
        gone = least[rank] < doc
        texts, words, removed, spans = [], [], [], []
        at = 0
        for (_, _, w), k in zip(blocks, kept, strict=True):
            starts = w.at[k[gone[at : at + len(k)]]]
            at += len(k)
            cover = np.zeros(len(w.starts) + 1, np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, np.minimum(starts + window, len(w.starts)), -1)
            covered = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            for a, b in zip(w.firsts[:-1].tolist(), w.firsts[1:].tolist(), strict=True):
                words.append(b - a)
                n = int(total[b] - total[a])
                removed.append(n)
                own = w.data[w.starts[a] : w.stops[b - 1]].tobytes().split() if b > a else []
                if not n:
                    spans.append([])
                    texts.append(b" ".join(own))
                    continue
                turn = np.flatnonzero(np.diff(np.concatenate([[False], covered[a:b], [False]]).astype(np.int8))).tolist()
                spans.append([{"start": s, "stop": e} for s, e in zip(turn[::2], turn[1::2], strict=True)])
                texts.append(b" ".join([x for s, e in zip([0, *turn[1::2]], [*turn[::2], b - a], strict=True) for x in own[s:e]]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table({"_row": table.column("_row"), "_text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span)})

    *lengths, _ = levels(window, least)
    lengths = lengths or [window]
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    sent = dealt.groupBy("_part").applyInArrow(first, "bucket long, part long, key binary")
    for shorter, length in zip([None, *lengths], lengths, strict=False):
        if shorter:
            sent = dealt.groupBy("_part").cogroup(alive.groupBy("_part")).applyInArrow(extended(shorter, length), "bucket long, part long, key binary")  # noqa: F821
        alive = sent.groupBy("bucket").applyInArrow(shared_seeds, "part long, key binary")
        alive = alive.select(F.col("part").cast("int").alias("_part"), "key", *none("high", "low", "doc"))
    last = dealt.groupBy("_part").cogroup(alive.groupBy("_part")).applyInArrow(windows, "bucket long, part long, high binary, low binary, doc binary")
    owned = last.groupBy("bucket").applyInArrow(owners, "part long, high binary, low binary, doc binary")
    replies = alive.unionByName(owned.select(F.col("part").cast("int").alias("_part"), *none("key"), "high", "low", "doc"))
    done = dealt.groupBy("_part").cogroup(replies.groupBy("_part")).applyInArrow(remove, result)
    return done.select(*restored(docs.columns, "_row", **{text_col: "_text"}, n_words="n_words", n_removed="n_removed", spans="spans"))
