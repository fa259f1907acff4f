"""Chat formatting with a grammar round trip, all in DataFrame functions.

Grammar of a formatted conversation: ``turn*`` with

    turn := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Text and role can't hold either mark: where rendering and reparsing a turn does
not give the turn back, its control strings are escaped by one more backslash
between ``<`` and ``|`` (``<|x`` becomes ``<\\|x``, ``<\\|x`` becomes ``<\\\\|x``; a
line end in a role becomes ``<\\n|``).  The parser always takes one away, so a
text that holds none of these strings is rendered as it is.  Escaped turns are
reparsed and compared again, and so on until every turn is identical or
``rounds`` are over; one round is enough, as escaping is a bijection.

Defined results: null texts and roles count as empty; turns of one number are
ordered by role and text, null numbers first; rows of a null conv_id are one
conversation; an empty table gives an empty table.  A conversation is one row of
the result and must fit into memory as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriscope.llm.common import quoted

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def escape_role(x: Column) -> Column:
    return F.replace(escape(F.regexp_replace(x, r"<(\\*)n\|", r"<$1\\n|")), F.lit("\n"), F.lit("<n|"))


def unescape_role(x: Column) -> Column:
    return F.regexp_replace(F.replace(unescape(x), F.lit("<n|"), F.lit("\n")), r"<(\\*)\\n\|", r"<$1n|")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, raw>>: the turns of a formatted conversation;
    raw is the text as it stands there."""
    body = lambda x: F.substring_index(x, "\n", 1)
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        raw = F.split_part(F.substr(x, F.char_length(body(x)) + 2), F.lit(CLOSE), F.lit(1))
        return F.struct(unescape_role(body(x)).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.transform(pieces, turn)


def format_turns(turns: DataFrame, rounds: int = 2) -> DataFrame:
    """Adds ``shown``, each turn as rendered; needs columns role and text."""
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turns = turns.withColumns({"_r": F.col("role"), "_t": F.col("text")})
    for _ in range(rounds):
        read = parse(render(F.col("_r"), F.col("_t")))
        turns = turns.withColumn("_read", read)
        turn = F.get("_read", 0)
        same = (F.size("_read") == 1) & ~F.contains("_r", F.lit(CLOSE)) & (turn["role"] == F.col("role")) & (turn["text"] == F.col("text")) & (turn["raw"] == F.col("_t"))
        turns = turns.withColumn("_same", F.coalesce(same, F.lit(False)))
        turns = turns.withColumns({"_r": F.when(F.col("_same"), F.col("_r")).otherwise(escape_role(F.col("role"))), "_t": F.when(F.col("_same"), F.col("_t")).otherwise(escape(F.col("text")))})
    return turns.withColumn("shown", render(F.col("_r"), F.col("_t"))).drop("_r", "_t", "_read", "_same")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_from: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss (the spans of
    ``formatted``, from code point ``start`` on ``length`` long, that a model learns
    from: the texts of the ``learn_from`` role)."""
    rows = turns.select(F.col(quoted(conv_col)).alias("conv_id"), F.col(quoted(turn_col)).alias("turn"), F.col(quoted(role_col)).cast("string").alias("role"), F.col(quoted(text_col)).cast("string").alias("text"))
    rows = format_turns(rows)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("shown")).over(before), F.lit(0)))
    head = F.col("at") + F.char_length(F.substring_index("shown", "\n", 1)) + 1
    span = F.when(F.col("role") == learn_from, F.struct(head.alias("start"), (F.col("at") + F.char_length("shown") - head - len(CLOSE) - 1).alias("length")))
    rows = rows.select("conv_id", F.struct("at", "turn", "role", "text", "shown", span.alias("span")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_t"))
    spans = F.filter(F.transform("_t", lambda t: t["span"]), lambda x: x.isNotNull())
    return chats.select("conv_id", F.array_join(F.transform("_t", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns, what the parser reads from ``formatted``, and loss_text, the
    unescaped text under the loss spans."""
    chats = chats.withColumn("turns", F.transform(parse(F.col("formatted")), lambda x: F.struct(x["role"], x["text"])))
    masked = F.transform("loss", lambda x: unescape(F.substr("formatted", (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return chats.withColumn("loss_text", F.array_join(masked, ""))
