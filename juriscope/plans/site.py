"""Everything that an opinion's page shows, as one DataFrame for all opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.functions import documents, quotes, text
from juriscope.operators import authorities, citations, edges, history, later_courts
from juriscope.sources.json_corpus import Corpus


def segments(doc: Column) -> Column:
    """Plain blocks, then notes, writing by writing."""
    strip = lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", ""), r"\s+", " "))
    return F.flatten(F.transform(doc, lambda w: F.concat(F.transform(w["blocks"], lambda b: strip(b["html"])), F.transform(w["footnotes"], lambda f: strip(f["html"])))))


def writings(doc: Column) -> Column:
    return F.transform(doc, lambda w: F.array_join(F.concat(F.transform(w["blocks"], lambda b: b["html"]), F.transform(w["footnotes"], lambda f: f["html"])), " "))


def with_quotes(table: DataFrame, opinions: DataFrame, key: str, citations: str, name: str) -> DataFrame:
    """Q1, Q3, Q5, Q6 on ``quote`` of rows whose text is opinion ``key``. Rows without a
    quote take no part; the others meet their opinion's text once."""
    texts = opinions.select(F.col("cluster_id").alias(key), segments(F.col("document")).alias("_segments"), writings(F.col("document")).alias("_writings"))
    quoted = table.filter("quote <> ''").join(texts, key, "left").withColumn("quote", quotes.expand_udf("_segments", "quote"))
    quoted = quoted.withColumns({"quote_status": quotes.status(F.col("quote"), F.coalesce("_writings", F.array().cast("array<string>"))), "quote_names": text.quote_names_case(F.col("quote"), F.col(citations), F.col(name)), "quote_html": quotes.mark_udf("quote", citations, name)}).drop("_segments", "_writings")
    plain = table.filter("quote is null or quote = ''").withColumns({c: F.lit("") for c in ("quote_status", "quote_names", "quote_html")})
    return quoted.unionByName(plain)


def with_lead_status(later: DataFrame, opinions: DataFrame) -> DataFrame:
    """Q3 on the leading quote of each Later Courts row, whose text is the citing opinion."""
    texts = opinions.select(F.col("cluster_id").alias("citing"), writings(F.col("document")).alias("_writings"))
    quoted = later.filter("lead_quote <> ''").join(texts, "citing", "left")
    quoted = quoted.withColumn("lead_quote_status", quotes.status(F.col("lead_quote"), F.coalesce("_writings", F.array().cast("array<string>")))).drop("_writings")
    return quoted.unionByName(later.filter("lead_quote is null or lead_quote = ''").withColumn("lead_quote_status", F.lit("")))


def grids(corpus: Corpus, views: DataFrame) -> DataFrame:
    """(cluster_id, history): the grid of each opinion's whole chain, in the order of its nodes."""
    o = corpus.opinions
    pairs = edges.direct_history(corpus.edges)
    seeds = o.select("cluster_id")
    m = history.members(history.reach(pairs, pairs, seeds), seeds, o, corpus.courts)
    records = o.select(F.col("cluster_id").alias("node"), "case_name", "on_appeal", "disposition")
    nodes, links, _ = history.whole_chain(m, pairs, records, edges.reported_acts(views).withColumn("target", F.col("cited")))
    grid = history.laid_out(nodes, links)
    cell = F.struct(*[c for c in grid.columns if c != "cluster_id" and c != "at"])
    return grid.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", cell.alias("cell")))), lambda x: x["cell"]).alias("history"))


def bodies(opinions: DataFrame, authorities: DataFrame) -> DataFrame:
    """Bodies of writings, and of text documents where ``is_text`` tells of any."""
    if "is_text" not in opinions.columns:
        return citations.bodies(opinions, authorities)
    kind = F.coalesce("is_text", F.lit(False))
    # Links look at the whole collection, so only the documents of the other kind are emptied.
    of = lambda mine: opinions.withColumn("document", F.when(mine, F.col("document")))
    text = citations.text_bodies(of(kind), authorities).filter("body is not null")
    return citations.bodies(of(~kind), authorities).unionByName(text)


def pages(corpus: Corpus) -> DataFrame:
    """One row for each opinion: its lists in page order, its status, its chain, its text."""
    o, courts = corpus.opinions, corpus.courts
    views = edges.valid(edges.joined(corpus.edges, o, courts))
    later = with_lead_status(later_courts.ranks(later_courts.rows(views)), o)
    auth = authorities.ranks(authorities.rows(corpus.groups, o, courts))
    listed = lambda t, key, order, name: t.groupBy(F.col(key).alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*[c for c in t.columns if c not in (key, "first_ord")]).alias("row")))), lambda x: x["row"]).alias(name))
    paragraphs = F.flatten(F.transform("document", lambda w: F.transform(F.filter(w["blocks"], lambda b: b["type"].isin("paragraph", "blockquote")), lambda b: F.trim(F.regexp_replace(F.regexp_replace(b["html"], "<[^>]+>", ""), r"\s+", " ")))))
    return (
        o.filter("is_scoped").withColumns({"excerpt": text.excerpt(F.filter(paragraphs, lambda p: p != "")), "sections": documents.sections(F.col("document")), "disposition": text.disposition_label(F.col("disposition.label"), F.col("disposition.text")), "docket_numbers": text.docket_numbers(F.col("docket_number"))})
        .drop("on_appeal")
        .join(listed(later, "cited", "dom_index", "cited_by"), "cluster_id", "left")
        .join(listed(auth, "cluster_id", "dom_index", "cited_authorities"), "cluster_id", "left")
        .join(later_courts.statuses(later, o, courts), "cluster_id", "left")
        .join(corpus.counts, "cluster_id", "left")
        .join(bodies(o, auth), "cluster_id", "left")
        .join(grids(corpus, views), "cluster_id", "left")
    )
