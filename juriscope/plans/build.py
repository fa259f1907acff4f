"""A whole build: a source's pages published, its index and small tables written."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juriscope.functions import text
from juriscope.operators import edges, search
from juriscope.plans import site
from juriscope.sources import json_corpus, publish, sinks

#: What an index entry keeps of a page.
ENTRY = ["cluster_id", "case_name", "name_missing", "docket_numbers", "citations", "court", "tier", "date_filed", "dh_severity", "cr_severity"]


def entries(pages: DataFrame) -> DataFrame:
    """The index entry of each page, with what searches and cards read."""
    extra = {"search_text": text.search_text(F.col("case_name"), F.col("citations")), "date_short": text.short_date(F.col("date_filed")), "url": F.concat(F.lit("/opinion/"), F.col("cluster_id").cast("string"), F.lit("/"))}
    return pages.select(*ENTRY, *[c.alias(n) for n, c in extra.items()], "load_ord")


def build(spark: SparkSession, root: str, out: str, source: str | None = None, flags: dict[str, str] | None = None) -> dict:
    """Builds everything under ``out`` and returns what was done: pages added, changed, kept
    and removed, and the edges by verdict. The index is read back from the published pages,
    so it never names a page that isn't there."""
    corpus = json_corpus.load_source(source, spark, root)
    done = publish.publish(site.pages(corpus), f"{out}/pages")
    pages = publish.read(spark, f"{out}/pages")
    index = entries(pages)
    sinks.write_index(index, f"{out}/index", search.index_order())
    sinks.write_side_tables(spark, corpus.courts, f"{out}/side")
    scope = search.scope_counts(index, corpus.courts.count())
    set_ = spark.createDataFrame([(k, json_corpus.flag(v)) for k, v in (flags or {}).items()], "flag string, on boolean")
    for name, table in (("scope", scope), ("flags", set_), ("build", sinks.build_stamp(spark))):
        table.coalesce(1).write.mode("overwrite").json(f"{out}/side/{name}")
    views = edges.joined(corpus.edges, corpus.opinions, corpus.courts)
    return asdict(done) | {"edges": {r.verdict: r.n for r in edges.tallies(views).collect()}}
