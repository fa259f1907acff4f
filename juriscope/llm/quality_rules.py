"""Quality rules with cross-document line frequency, all in DataFrame functions.

Within a document: counts of words, symbols, repeated lines and words in repeated
windows.  Across documents: every line with a word is normalised (stripped, white
space collapsed, lower case) and hashed, and distinct documents are counted for each
host and line.  A line in over ``line_share`` of its host's documents, and in over
``line_floor`` of them, is boilerplate and is taken out.  A document left with less
than ``least_left`` of its words is depleted and rejected.

Defined results: a null text has no words and fails the base rules; null hosts form
one host; rows that repeat an id are one document of each of their hosts, and each row
gets its own verdict; a row with a null id counts as a document by its text; an empty
table gives an empty table; other columns pass whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.llm.common import carried, quoted, restored, written

_SPACE = "[\\x20\\x09-\\x0D]+"
_A_WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def repeated_words(docs: DataFrame, words: str, window: int, out: str) -> DataFrame:
    """Adds ``out``: words covered by windows that occur twice or more in ``words``."""
    n = F.size(words)
    hashes = F.when(n < window, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, window))))
    # Each step is read twice or more by the next, so that Catalyst keeps it a
    # projection of its own and no lambda computes it anew for every element.
    docs = docs.withColumn("_h", hashes)
    docs = docs.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    docs = docs.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    gaps = F.transform("_p", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_p", k + 1) - p, F.lit(window))))
    docs = docs.withColumn(out, F.coalesce(F.when(F.size("_p") > 0, F.aggregate(gaps, F.lit(0), lambda a, g: a + g)), F.lit(0)).cast("long"))
    return docs.drop("_h", "_s", "_p")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, _SPACE, " ")))


def frequent_lines(base: DataFrame, line_share: float, line_floor: int) -> DataFrame:
    """(host, h) of the lines above the limits, from ``measure``'s rows."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "tid"))
    rows = base.withColumn("who", F.xxhash64(who))
    hosts = rows.select("host", "who").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    each = rows.select("host", "who", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    counts = each.groupBy("host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > line_floor)
    return counts.join(hosts, "host").filter(F.col("n_docs") > line_share * F.col("n_host")).select("host", "h")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = 8) -> DataFrame:
    """(doc_id, tid, host, the base counts, lines): one row for each row of ``docs``;
    tid is a hash of the text, lines holds hash and words of every line with a word."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    docs = docs.select(*_key(id_col, text_col, host_col), text.alias("text"))
    docs = docs.withColumn("_w", words_of(F.col("text")))
    docs = docs.withColumns({"n_words": F.size("_w").cast("long"), "word_chars": F.char_length(F.array_join("_w", "")).cast("long")})
    docs = docs.withColumn("n_symbols", F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long"))
    docs = repeated_words(docs, "_w", window, "n_repeat_words")
    docs = docs.withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(_A_WORD)))
    docs = docs.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    lines = F.transform(F.transform("_l", normal_line), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w")))
    return docs.withColumn("lines", lines).drop("_w", "_l", "text")


def _key(id_col: str, text_col: str, host_col: str) -> list[Column]:
    """What tells rows apart: id, a hash of the text, host."""
    text, host = (F.col(quoted(c)).cast("string") for c in (text_col, host_col))
    return [F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.coalesce(host, F.lit("")).alias("host")]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_share: float = 0.05, line_floor: int = 3, least_left: float = 0.7, min_words: int = 20, max_repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """(doc_id, tid, host, counts, n_line_words, frequent, base_failed, kept): the
    verdict on each row; frequent holds the hashes of its lines above the limits."""
    base = written(measure(docs, id_col, text_col, host_col, window), "rules")
    often = written(frequent_lines(base, line_share, line_floor), "often")
    lines = base.select("doc_id", "tid", "host", F.posexplode("lines").alias("pos", "l")).select("doc_id", "tid", "host", "pos", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    # Rows that are the same throughout meet in one group; dividing undoes that.
    once = F.sum("w") * F.size(F.collect_set("pos")) / F.count("*")
    found = lines.join(often, ["host", "h"]).groupBy(F.col("doc_id").alias("_d"), F.col("tid").alias("_t"), F.col("host").alias("_o")).agg(once.cast("long").alias("n_line_words"), F.collect_set("h").alias("frequent"))
    whole = base.drop("lines").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tid") == F.col("_t")) & (F.col("host") == F.col("_o")), "left").drop("_d", "_t", "_o")
    whole = whole.withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    whole = whole.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    left = F.col("n_words") - F.col("n_line_words")
    return whole.withColumn("kept", ~F.col("base_failed") & (left >= least_left * F.col("n_words")))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rules) -> DataFrame:
    """The documents that the rules keep, without their lines above the limits."""
    verdicts = judge(docs, id_col, text_col, host_col, **rules).filter("kept").select(*[F.col(c).alias(f"of_{c}") for c in ("doc_id", "tid", "host")], "frequent").distinct()
    rows = docs.select(carried(docs).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"), *_key(id_col, text_col, host_col))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("tid") == F.col("of_tid")) & (F.col("host") == F.col("of_host"))
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("frequent", F.xxhash64(normal_line(x)))), "\n")
    kept = rows.join(verdicts, same).withColumn("text", F.when(F.col("frequent").isNull(), F.col("text")).otherwise(text))
    return kept.select(*restored(docs.columns, "row", **{text_col: "text"}))
