"""Functions for SQL text: quotes (Q1, Q3, Q6), and a table function of html blocks (H2)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from juriscope.functions import documents, quotes


class HtmlBlocks:
    """One row for each block of an html text: SELECT ... FROM t, LATERAL html_blocks(t.html)."""

    def eval(self, source: str) -> Iterator[tuple[int, str, str]]:
        for pos, block in enumerate(documents.blocks_of(source or "")[0]):
            yield pos, block["type"], block["html"]


def register(spark: SparkSession) -> None:
    """Makes ``expand_quote(segments, quote)``, ``verify_quote(writings, quote)``,
    ``mark_case(quote, citations, name)`` and ``html_blocks(html)`` known to the session."""
    spark.udf.register("expand_quote", F.pandas_udf(quotes._expand, "string"))
    spark.udf.register("verify_quote", F.pandas_udf(quotes._verify, "status string, coverage double, sentences double"))
    spark.udf.register("mark_case", F.pandas_udf(quotes._mark, "string"))
    spark.udtf.register("html_blocks", F.udtf(HtmlBlocks, returnType="pos int, type string, html string", useArrow=True))
