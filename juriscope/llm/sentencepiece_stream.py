"""SentencePiece encoding and decoding by streaming Viterbi.

Pieces and scores come from a SentencePiece model file.  The best segmentation is
the one whose piece scores sum to the most (of equal ones the one whose last
piece is longer, at every place).  Characters that no piece covers cost the
lowest score less ten and are encoded as their UTF-8 bytes' pieces.

The search keeps the best score and the backpointer of the path that ends at each
boundary, a step of the longest piece's length at a time.  A boundary that all paths
run through which can still go on can't change any more: its ids are committed and
everything before it is forgotten, scores of the rest staying relative to it.  What is
held is the last committed boundary's distance, in practice a few pieces, and work
grows in proportion to the text, with blanks or without.

Such a boundary starts the search afresh, so what was committed between two of them is
a function of the characters between and of nothing else.  Where the vocabulary itself
forces them (before a blank that follows another character and at line ends, when no
piece spans those) the stream keeps what it has committed in a bounded memory and goes
on from the next forced boundary when it meets the same stretch again.

A model trained for BPE merges has ranks as scores.  Viterbi then gives the
segmentation of the least rank sum, which is not always the one that merging
gives; decoding restores the text in both cases.

Defined results: null and empty texts have no ids and decode to the empty text;
U+2581 in a text reads back as a blank (the model writes blanks that way); rows that
repeat an id each get their row; a null id is carried through; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juriscope.llm.common import quoted

BLANK = "▁"
_NEVER = float("-inf")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (model.get_score(i), i) for i in plain}
        #: By first letter: what may follow it, the score of the piece that ends here (or None), its id.
        self.trie: dict[str, list] = {}
        for p, (score, i) in self.pieces.items():
            level, node = self.trie, None
            for c in p:
                node = level.setdefault(c, [{}, None, -1])
                level = node[0]
            node[1:] = score, i
        self.longest = max(map(len, self.pieces))
        self.unknown_score = min(s for s, _ in self.pieces.values()) - 10
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: p.replace(BLANK, " ").encode() for p, (_, i) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        #: No piece holds a line end, or a blank after another character.
        self.divides = not any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.pieces)


class Stream:
    """Viterbi over characters fed in any portions."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.ids, self.commits, self.most = vocabulary, [], 0, 0
        self._restart()

    def _restart(self) -> None:
        self.text = ""  # from the last committed boundary on
        self.best = [0.0]  # for each boundary of ``text``, the best score of a path to it
        self.back: list[tuple[int, int] | None] = [None]  # start of the last piece and its id, -1 for unknown
        self.done = 0  # boundaries from here on still have pieces to start

    def feed(self, text: str, last: bool = False) -> None:
        if last and len(text) <= self.v.longest and not self.text:  # one step, committed as a whole
            self.text, self.best, self.back = text, [0.0, *[_NEVER] * len(text)], [None] * (len(text) + 1)
            text = ""
        for i in range(0, len(text), self.v.longest):
            self._step(text[i : i + self.v.longest])
        if last:
            self._advance(len(self.text))
            self._take(len(self.text))
            self._restart()

    def _step(self, text: str) -> None:
        self.text += text
        self.best += [_NEVER] * len(text)
        self.back += [None] * len(text)
        self.most = max(self.most, len(self.text))
        self._advance(len(self.text) - self.v.longest)  # a later start may lack the end of its pieces
        self._commit()

    def _advance(self, stop: int) -> None:
        trie, unknown, s, best, back, n = self.v.trie, self.v.unknown_score, self.text, self.best, self.back, len(self.text)
        for i in range(self.done, stop):
            here, j, level = best[i], i, trie
            while j < n:
                node = level.get(s[j])
                if node is None:
                    break
                j += 1
                level, score, piece = node
                if score is not None and here + score > best[j]:
                    best[j], back[j] = here + score, (i, piece)
            node = trie.get(s[i])
            if (node is None or node[1] is None) and here + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + unknown, (i, -1)
        self.done = max(self.done, stop)

    def _commit(self) -> None:
        """Commits up to the last boundary that all surviving paths run through: those that
        end where pieces still start, ``longest`` boundaries at most."""
        alive = {j for j in range(self.done, len(self.best)) if self.best[j] > _NEVER}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(self.back[top][0])
        at = alive.pop()
        if at:
            self.commits += 1
            self._take(at)
            # Scores from the new start on keep their differences and stay small.
            zero = self.best[at]
            self.text, self.best = self.text[at:], [b - zero for b in self.best[at:]]
            self.back = [None if b is None or b[0] < at else (b[0] - at, b[1]) for b in self.back[at:]]
            self.done -= at

    def _take(self, end: int) -> None:
        out = []
        while end:
            start, piece = self.back[end]
            out += [piece] if piece >= 0 else [self.v.bytes[b] for b in reversed(self.text[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        self.ids += out[::-1]


class _Committed(dict):
    """What the stream commits for a stretch between two forced boundaries; of those not
    met for long the older half is forgotten."""

    def __init__(self, codec: "Codec", head: str):
        self.codec, self.head, self.older = codec, head, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch) or self.codec.streamed(self.head + stretch)
        if len(stretch) <= 64:
            if len(self) >= self.codec.cached:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


class Codec:
    def __init__(self, path: str, cached: int = 250_000):
        self.v, self.cached = Vocabulary(path), cached
        self.stream, self.commits, self.most = Stream(self.v), 0, 0  # commits, and the longest text held at once
        self.after_blank, self.after_line = _Committed(self, BLANK), _Committed(self, "")
        self.stretches = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+").findall
        self.line_end = self.streamed("\n")

    def streamed(self, text: str) -> bytes:
        stream = self.stream
        stream.feed(text, last=True)
        self.commits, self.most = stream.commits, stream.most
        ids, stream.ids = stream.ids, []
        return struct.pack(f"<{len(ids)}I", *ids)

    def _line(self, line: str) -> list[bytes]:
        """Ids of a line whose blanks are U+2581, stretch by stretch."""
        if BLANK * 2 in line:  # a stretch starts with all of its blanks
            return [self.after_line[x] for x in self.stretches(line)]
        first, *rest = line.split(BLANK)
        return [self.after_line[first] if first else b"", *map(self.after_blank.__getitem__, rest)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        text = BLANK + text.replace(" ", BLANK)
        if not self.v.divides:
            return self.streamed(text)
        return self.line_end.join([b"".join(self._line(line)) for line in text.split("\n")])

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.v.text.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec_of(model: str) -> Codec:
    """One codec for each worker: what a task has learned serves the next."""
    return Codec(model)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian 32-bit bytes, one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for i in range(0, len(batch), 512):
                some = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([codec.encode(x or "") for x in some.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): the text of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for i in range(0, len(batch), 512):
                some = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([codec.decode(x) for x in some.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, restored): restored tells whether decoding the ids gives the text
    (with its U+2581 as blanks) again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for i in range(0, len(batch), 512):
                some = batch.slice(i, 512)
                texts = [x or "" for x in some.column(1).to_pylist()]
                ids = [codec.encode(x) for x in texts]
                same = [codec.decode(x) == text.replace(BLANK, " ") for x, text in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array(same)], ["doc_id", "ids", "restored"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, restored boolean")
