"""Conversation structure repair by a forward Viterbi pass over a grammar of roles.

Grammar: a conversation is empty, or an optional system turn and then pairs of a user and
an assistant turn.  Four states say what has been read: nothing, the system turn, a user
turn, a pair; the first and the last may end.  What comes next is fixed by the state but
for the system turn at the start, so a string of edits says all: K keeps a turn, R gives
it the role that comes next, D deletes it, I inserts an empty turn of that role.

Pass: turns go by in order, and each state carries the least (cost, edits) that lead to
it, ties by the ASCII order of the edits.  The layer of a turn is closed by inserts: three
lead from any state to any other that an insert can reach.  Equal costs in one state
never leave one string a prefix of the other, as the edits fix cost and state, so the
lesser string stays the lesser whatever follows.

Memory: a state that costs over ``APART`` more than the best can't win any more, as the
best one reaches all that it can for less; it goes.  What the strings of the others have
in common at their start is decided: it is applied to the turns that wait, which leave.
A conversation thus streams through its task, sorted by Spark, and isn't gathered there;
which turns are repeated is found by a window over conversation and content.

Faults, the first of a turn counts: ``blank`` (no character outside the white space),
``duplicate`` (role and text seen earlier in the conversation), ``truncated`` (the last
such character isn't one of ``.!?``).  Blank and duplicate turns are deleted, for 2 like
all others; a truncated turn that stays costs 5 more.

Defined results: a null role or text is one blank; turns without a number come first,
turns of one number in the order of role and text; rows without a conversation make one
of their own; rows whose ``present`` is false name their conversation only, and a
conversation of no others has zeros and nothing to repair; roles are told by their first
character, all but s, u and a fit nowhere; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juriscope.llm.common import SPACES

#: State after an edit that adds the role which comes next, and that role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: State after a kept turn by its role's initial; states not named don't take it.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Two inserts and a deletion: what any state needs at most to do what another can.
APART = 2 * INSERT + DELETE
#: Length of undecided edits at which decided ones are looked for.
UNDECIDED = 256

FAULTS = ("", "blank", "duplicate", "truncated")


def faulty(turns: DataFrame) -> DataFrame:
    """``turns`` with the first fault of each row, a number as FAULTS has them, and ``nth``:
    which row of its content it is in its conversation."""
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    again = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(said == "", 1).when(F.col("nth") > 1, 2).when(~F.substring(said, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return turns.withColumn("nth", F.row_number().over(again)).withColumn("fault", fault)


class Repair:
    """One conversation: takes its turns in order, calls ``out`` with each repaired turn
    (role, text, edit) as soon as it is decided."""

    def __init__(self, out: Callable[[str, str, str], None]):
        self.out = out
        self.counts = [0, 0, 0, 0]
        self.illegal = self.n_turns = 0
        self.before: str | None = None
        self.first = self.last = None
        # State: (cost, undecided edits). Decided edits, the cost and state after them.
        self.layer: dict[int, tuple[int, str]] = {0: (0, "")}
        self.decided: list[str] = []
        self.state, self.forced, self.limit = 0, 0, UNDECIDED
        self.waiting: deque[tuple[str, str] | None] = deque()
        self._close()

    def turn(self, number: int | None, role: str, text: str, fault: int) -> None:
        if number is not None and number != self.last:
            self.n_turns += 1
            self.first, self.last = number if self.first is None else self.first, number
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if fault in (1, 2):
            # Deleted in every state; inserts after the run are less in ASCII than within it.
            self.forced += 1
            self.waiting.append(None)
            return
        self._delete_forced()
        self.waiting.append((role, text))
        more, kept = TRUNCATED * (fault == 3), KEEP.get(role[:1], {})
        new: dict[int, tuple[int, str]] = {}
        for state, (cost, edits) in self.layer.items():
            options = [(state, cost + DELETE, "D"), (NEXT[state], cost + RENAME + more, "R")]
            if state in kept:
                options.append((kept[state], cost + more, "K"))
            for to, price, edit in options:
                if to not in new or (price, edits + edit) < new[to]:
                    new[to] = (price, edits + edit)
        self.layer = new
        self._close()

    def _close(self) -> None:
        for _ in range(3):
            for state, (cost, edits) in list(self.layer.items()):
                to, option = NEXT[state], (cost + INSERT, edits + "I")
                if to not in self.layer or option < self.layer[to]:
                    self.layer[to] = option
        best = min(cost for cost, _ in self.layer.values())
        self.layer = {s: x for s, x in self.layer.items() if x[0] <= best + APART}
        if max(len(edits) for _, edits in self.layer.values()) > self.limit:
            sure = commonprefix([edits for _, edits in self.layer.values()])
            self._apply(sure)
            self.layer = {s: (cost, edits[len(sure) :]) for s, (cost, edits) in self.layer.items()}
            self.limit = UNDECIDED + 2 * max(len(edits) for _, edits in self.layer.values())

    def _delete_forced(self) -> None:
        if self.forced:
            run, price, self.forced = "D" * self.forced, DELETE * self.forced, 0
            self.layer = {s: (cost + price, edits + run) for s, (cost, edits) in self.layer.items()}
            self._close()

    def _apply(self, edits: str) -> None:
        self.decided.append(edits)
        for edit in edits:
            if edit == "I":
                self.out(ROLE[self.state], "", edit)
                self.state = NEXT[self.state]
                continue
            held = self.waiting.popleft()
            if edit == "K":
                self.out(*held, edit)
                self.state = KEEP[held[0][:1]][self.state]
            elif edit == "R":
                self.out(ROLE[self.state], held[1], edit)
                self.state = NEXT[self.state]

    def end(self) -> tuple[int, int, int, int, int, int, str]:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit)"""
        self._delete_forced()
        cost, edits = min(self.layer[s] for s in (0, 3) if s in self.layer)
        self._apply(edits)
        gaps = self.last - self.first + 1 - self.n_turns if self.n_turns else 0
        return gaps, *self.counts[1:], self.illegal, cost, "".join(self.decided)


def _conversations(turns: DataFrame, start: Callable[[int | None, Callable], Repair], end: Callable[[int | None, Repair, Callable], None], names: list[str], schema: str) -> DataFrame:
    """Streams every conversation through a Repair of its own. ``start`` makes it, and
    ``end`` finishes it, both for the rows that the task returns."""
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("present", F.lit(True)).alias("present"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    sorted_rows = faulty(given).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "present", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, repair = None, None

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for conv_id, turn, role, text, present, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if repair is None or conv_id != now:
                    if repair is not None:
                        end(now, repair, rows.append)
                    now, repair = conv_id, start(conv_id, rows.append)
                if present:
                    repair.turn(turn, role, text, fault)
                if len(rows) >= 4096:
                    yield table()
        if repair is not None:
            end(now, repair, rows.append)
        if rows:
            yield table()

    types = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]
    return sorted_rows.mapInArrow(run, schema)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the repaired turns of all conversations of
    ``turns`` (conv_id, turn, role, text, present)."""

    def start(conv_id, add):
        at = iter(range(1 << 62))
        return Repair(lambda role, text, edit: add((conv_id, next(at), role, text, edit)))

    return _conversations(turns, start, lambda conv_id, repair, add: repair.end(), ["conv_id", "position", "role", "text", "edit"], "conv_id long, position long, role string, text string, edit string")


def report(turns: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, the cost and the
    edits of its repair, the number of repaired turns and their SHA-256 (``role:text``,
    joined by newlines)."""

    def start(conv_id, add):
        digest, n = hashlib.sha256(), 0

        def out(role: str, text: str, edit: str) -> None:
            nonlocal n
            digest.update(("\n" * (n > 0) + role + ":" + text).encode())
            n += 1

        repair = Repair(out)
        repair.finish = lambda: (*repair.end(), n, digest.hexdigest())
        return repair

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "n_repaired", "repaired_sha256"]
    schema = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in names)
    return _conversations(turns, start, lambda conv_id, repair, add: add((conv_id, *repair.finish())), names, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults made by a hash of conversation and turn: of twenty rows one is
    dropped (``present`` is false), emptied, robbed of its stops, repeated, or the user's."""
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    row = F.struct(
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (code != 0).alias("present"),
    )
    return turns.select("conv_id", "turn", F.explode(F.array_repeat(row, F.when(code == 3, 2).otherwise(1))).alias("r")).select("conv_id", "turn", "r.*")
