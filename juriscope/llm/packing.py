"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps at most ``open_windows`` open windows.  A document (or what
is left of it after cutting whole windows off a long one) goes whole to the open
window that it fits best, or opens one while there is room.  When none fits, the
fullest window takes the document's head, which fills it, and is emitted, and the
rest is placed anew.  What is open at the end of ``merge_parts`` partitions is
merged: the largest leftover windows are topped up from the smallest ones, and
the last tokens form sequences whose lengths are powers of two.  So no sequence
is padded, and only leftover windows move between machines: at most
``open_windows`` windows a partition, whatever the input.

Defined results: null and empty texts are documents of the end id alone; rows
that repeat an id are packed one by one; a null id is carried through; an empty
table gives an empty table.  One text's ids at most are held beside the windows.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juriscope.llm.common import quoted, written

_WIDTH = 4  # bytes of an id


#: How the tokenizer's files divide a text, for lower-case text in Latin-1 (letters,
#: single digits, other characters but white space); fixed values.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies use for each byte."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Ids by text, found by ``find`` the first time; forgets all when it holds too many."""

    def __init__(self, find, most: int):
        self.find, self.most = find, most

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self.find(text)
        if len(text) <= 64:
            self[text] = ids
        return ids


class _Model:
    """Ids of one word from the tokenizer's model."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __call__(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(shown)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    Texts in Latin-1 without control strings are divided into words here, at blanks
    first and then the way the tokenizer's files say; bounded caches keep the ids of
    pieces and words met before, and the tokenizer's own model finds the others.  All other texts
    go through the tokenizer as a whole.  Files that divide texts in another way
    are told by a probe and go through the tokenizer too."""

    def __init__(self, path: str, end_id: int, cached: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = struct.pack("<I", end_id)
        words = _Known(_Model(self.tokenizer.model), cached)
        find = re.compile(_SPLIT).findall
        self.pieces = _Known(lambda piece: b"".join(map(words.__getitem__, find(piece.lower()))), cached)
        self.quick = True
        probe = "".join(map(chr, range(256))) + " It's 42% of THE Stra\xdfe, we'll n't''s\x1cx \xc0\xbd\xb2!!\xa0y"
        self.quick = self.one(probe) == self.slow(probe)

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str) -> bytes:
        if not self.quick or "<|" in text:
            return self.slow(text)
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.slow(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        return (self.one(text) + self.end for text in texts)


class Packer:
    """Windows of one partition; a piece is (doc, start, doc_tokens, ids)."""

    def __init__(self, size: int, open_windows: int, out):
        self.size, self.most, self.out = size, open_windows, out
        self.gaps: list[tuple[int, int]] = []  # sorted; the gap and the number of each open window
        self.windows: dict[int, list[tuple]] = {}
        self.made = 0

    def _put(self, number: int, gap: int, doc, start: int, total: int, ids: bytes) -> None:
        self.windows.setdefault(number, []).append((doc, start, total, ids))
        gap -= len(ids) // _WIDTH
        if gap:
            insort(self.gaps, (gap, number))
        else:
            self.out(number, self.windows.pop(number), False)

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // _WIDTH
        at = 0
        while total - at >= self.size:
            self._put(self._new(), self.size, doc, at, total, ids[at * _WIDTH : (at + self.size) * _WIDTH])
            at += self.size
        while at < total:
            i = bisect_left(self.gaps, (total - at, -1))
            if i < len(self.gaps):
                gap, number = self.gaps.pop(i)
            elif len(self.gaps) < self.most:
                gap, number = self.size, self._new()
            else:
                gap, number = self.gaps.pop(0)
            stop = min(total, at + gap)
            self._put(number, gap, doc, at, total, ids[at * _WIDTH : stop * _WIDTH])
            at = stop

    def close(self) -> None:
        for _, number in self.gaps:
            self.out(number, self.windows[number], True)


def merge_windows(windows: list[list[tuple]], size: int) -> Iterator[list[tuple]]:
    """Full sequences from partly filled windows, largest first, topped up from the
    smallest; then the rest in lengths that are powers of two."""
    held = sorted(windows, key=lambda w: sum(len(p[3]) for p in w))
    held = [[*w][::-1] for w in held]  # next piece last
    low, high = 0, len(held) - 1
    now: list[tuple] = []
    room = size

    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, total, ids = piece
        return (doc, start, total, ids[: n * _WIDTH]), (doc, start + n, total, ids[n * _WIDTH :])

    while low <= high:
        if not now:
            now = held[high][::-1]
            room = size - sum(len(p[3]) for p in now) // _WIDTH
            high -= 1
        while room and low <= high:
            piece = held[low].pop()
            if len(piece[3]) // _WIDTH > room:
                piece, rest = cut(piece, room)
                held[low].append(rest)
            now.append(piece)
            room -= len(piece[3]) // _WIDTH
            if not held[low]:
                low += 1
        if not room:
            yield now
            now = []
    left = now[::-1]
    rest = sum(len(p[3]) for p in left) // _WIDTH
    while rest:
        goal = 1 << (rest.bit_length() - 1)
        rest -= goal
        now = []
        while goal:
            piece = left.pop()
            if len(piece[3]) // _WIDTH > goal:
                piece, more = cut(piece, goal)
                left.append(more)
            now.append(piece)
            goal -= len(piece[3]) // _WIDTH
        yield now


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Rows:
    """Rows of pieces in Arrow columns."""

    def __init__(self, fields):
        self.fields, self.columns, self.bytes = fields, [[] for _ in fields], 0

    def add(self, sequence: int, pieces: list[tuple], *more) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // _WIDTH
            for column, x in zip(self.columns, (doc, start, n, total, sequence, offset, ids, *more), strict=True):
                column.append(x)
            offset += n
            self.bytes += len(ids)

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(self.columns, self.fields, strict=True)], [n for n, _ in self.fields])
        self.columns, self.bytes = [[] for _ in self.fields], 0
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, open_windows: int = 64, merge_parts: int = 4, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 512) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset
    and ids (little-endian 32-bit). ``tokenizer`` is the path of a tokenizers file."""
    open_fields = [*_FIELDS, ("open", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows, encode = _Rows(open_fields), Encoder(tokenizer, end_id)
        packer = Packer(size, open_windows, lambda number, pieces, left: rows.add((part << 32) + number, pieces, left))
        for batch in batches:
            for i in range(0, len(batch), batch_rows):
                some = batch.slice(i, batch_rows)
                texts = [x or "" for x in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), encode(texts), strict=True):
                    packer.add(doc, ids)
                    if rows.bytes > 8 << 20:
                        yield rows.take()
        packer.close()
        yield rows.take()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        windows: dict[int, list[tuple]] = {}
        order = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, total, number, ids in zip(*(order.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "sequence_id", "ids")), strict=True):
            windows.setdefault(number, []).append((doc, start, total, ids))
        rows = _Rows(_FIELDS)
        for i, pieces in enumerate(merge_windows(list(windows.values()), size)):
            rows.add((1 << 62) + (part << 32) + i, pieces)
        return pa.Table.from_batches([rows.take()])

    packed = written(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, _SCHEMA + ", open boolean"), "packed")
    left = packed.filter("open").drop("open").groupBy(F.expr(f"shiftright(sequence_id, 32) div {merge_parts}").alias("_part")).applyInArrow(merge, _SCHEMA)
    return packed.filter("not open").drop("open").unionByName(left)
