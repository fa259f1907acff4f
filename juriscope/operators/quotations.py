"""Passages and the texts that may hold them, by postings of runs of tokens (Q3 at scale).

A quote aligns with a text only about a run that both hold: the first four tokens, the last
four or those in the middle, of the quote or of one of its sentences.  Both sides become
tables of such runs and meet by them; pairs that share none have status ``missing`` and are
never made.  A text's runs are all of its runs of four tokens, and of two and three for the
middles of sentences shorter than eight tokens; only texts and passages that meet are read
again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.functions.text import tokens

#: Tokens of a run; a quote of fewer is too short to be looked for.
RUN = 4


def _at(words: Column, place: Column) -> Column:
    return F.array_join(F.slice(words, place + 1, RUN), " ")


def anchors(quote: Column) -> Column:
    """The runs by which a quote may be found: of itself and of its sentences."""
    parts = F.concat(F.array(quote), F.split(quote, r"(?<=[.?!])\s+|\s…\s"))
    long = F.filter(F.transform(parts, tokens), lambda w: F.size(w) >= RUN)
    middle = lambda w: F.floor(F.size(w) / 2).cast("int")
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.array(_at(w, F.lit(0)), _at(w, middle(w)), _at(w, F.size(w) - RUN)))))


def runs(words: Column) -> Column:
    """All runs of two to four tokens of a text."""
    every = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(every(2), every(3), every(RUN)))


def candidates(passages: DataFrame, texts: DataFrame, passage_id: str, quote: str, text_id: str, text: str) -> DataFrame:
    """Pairs (text_id, passage_id) that share a run, each once, with both texts."""
    asked = passages.select(passage_id, F.explode(anchors(F.col(quote))).alias("run"))
    # The tokens stay a projection of their own, as runs read them many times.
    words = texts.select(text_id, tokens(F.col(text)).alias("w"))
    held = words.select(text_id, F.explode(runs(F.col("w"))).alias("run")).join(asked.select("run").distinct(), "run", "left_semi")
    pairs = held.join(asked, "run").select(text_id, passage_id).distinct()
    return pairs.join(passages.select(passage_id, quote), passage_id).join(texts.select(text_id, text), text_id)
