"""Citations in the text of opinions, tied to Authorities rows, and the bodies of pages.

The text of all opinions is a table of segments (blocks and notes).  Their citation tags are
a table of spans, one row for each, which joins the Authorities rows by opinion and number
and the collection by id; the markup of the spans is spliced back between the pieces of text
that the tags divide.  All of it is columns but the balancing of inline tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.functions.documents import balanced_udf
from juriscope.functions.literals import map_of
from juriscope.functions.text import escape_html, filled, section_anchor

#: A citation's tag with its label.
TAG = r"<citedCase[^>]*>.+?</citedCase>"
# The icons of negative tiers.
ICONS = {
    "Stop": "M10 18a8 8 0 100-16 8 8 0 000 16zM8.28 7.22a.75.75 0 00-1.06 1.06L8.94 10l-1.72 1.72a.75.75 0 101.06 1.06L10 11.06l1.72 1.72a.75.75 0 101.06-1.06L11.06 10l1.72-1.72a.75.75 0 00-1.06-1.06L10 8.94 8.28 7.22z",
    "Warning": "M8.485 2.495c.673-1.167 2.357-1.167 3.03 0l6.28 10.875c.673 1.167-.17 2.625-1.516 2.625H3.72c-1.347 0-2.189-1.458-1.515-2.625L8.485 2.495zM10 5a.75.75 0 01.75.75v3.5a.75.75 0 01-1.5 0v-3.5A.75.75 0 0110 5zm0 9a1 1 0 100-2 1 1 0 000 2z",
    "Caution": "M18 10a8 8 0 11-16 0 8 8 0 0116 0zm-7 4a1 1 0 11-2 0 1 1 0 012 0zm-1-9a.75.75 0 00-.75.75v3.5a.75.75 0 001.5 0v-3.5A.75.75 0 0010 5z",
}
# The tag and class of each type of block.
BLOCK_TAGS = {
    "paragraph": ("p", ""),
    "blockquote": ("blockquote", ""),
    "heading": ("h3", "opinion-heading"),
    "author": ("p", "opinion-author"),
    "judges": ("p", "opinion-judges"),
    "attorneys": ("p", "opinion-attorneys"),
}
SEGMENT = ["cluster_id", "w", "k"]


def marker(tier: str) -> str:
    """The marker of a negative tier."""
    about = f'class="cited-case__severity cited-case__severity--{tier.lower()} tooltip-target" data-tooltip="{tier}" role="img" aria-label="Treatment severity: {tier}"'
    return f'<span {about}><svg viewBox="0 0 20 20" fill="currentColor" aria-hidden="true"><path fill-rule="evenodd" d="{ICONS[tier]}" clip-rule="evenodd" /></svg></span>'


def segments(opinions: DataFrame) -> DataFrame:
    """(cluster_id, w, k, title, note, type, label, id, ref_id, html): the blocks and notes
    of each writing of ``document``, in order."""
    text = lambda x: x.cast("string")
    piece = lambda x, note: F.struct(F.lit(note).alias("note"), text(F.lit(None) if note else x["type"]).alias("type"), *[text(x[c] if note else F.lit(None)).alias(c) for c in ("label", "id", "ref_id")], x["html"].alias("html"))
    none = F.array().cast("array<struct<note:boolean,type:string,label:string,id:string,ref_id:string,html:string>>")
    every = lambda w: F.concat(F.coalesce(F.transform(w["blocks"], lambda b: piece(b, False)), none), F.coalesce(F.transform(w["footnotes"], lambda n: piece(n, True)), none))
    each = opinions.select("cluster_id", F.posexplode("document").alias("w", "writing"))
    return each.select("cluster_id", (F.col("w") + 1).alias("w"), F.col("writing.title").alias("title"), F.posexplode(every(F.col("writing"))).alias("k", "s")).select("cluster_id", "w", "k", "title", "s.*")


def spans(parts: DataFrame) -> DataFrame:
    """(cluster_id, w, k, i, n, cited, case, manual, label): the citations of each segment."""
    tags = parts.select(*SEGMENT, F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("i", "tag"))
    attrs = F.regexp_extract("tag", "^<citedCase([^>]*)>", 1)
    of = lambda name: filled(F.regexp_extract(attrs, f'(?:^|[^a-z-]){name}="([^"]*)"', 1))
    label = F.regexp_extract("tag", "^<citedCase[^>]*>(.+?)</citedCase>$", 1)
    return tags.select(*SEGMENT, "i", of("data-group").cast("int").alias("n"), of("data-cluster-id").cast("bigint").alias("cited"), F.coalesce(of("data-case"), F.lit("")).alias("case"), of("data-manual").isNotNull().alias("manual"), label.alias("label"))


def _titled(name: Column) -> Column:
    return F.when(name == "", "").otherwise(F.concat(F.lit(' title="'), escape_html(name), F.lit('"')))


def linked(found: DataFrame, opinions: DataFrame, authorities: DataFrame | None = None) -> DataFrame:
    """``found`` (as ``spans`` returns it) with link, the markup of each citation: a
    chip that leads to its Authorities row, with a marker of the row's worst tier; without a
    row plain; without a group a link to the case's page, where the collection has it.
    ``authorities``: cluster_id, n, name, page_url, overall_severity."""
    scoped = opinions.filter("is_scoped").select(F.col("cluster_id").alias("cited"), F.lit(True).alias("scoped")).distinct()
    rows = found.join(scoped, "cited", "left")
    title = _titled(F.col("case"))
    page = F.concat(F.lit('<a class="cited-case" href="/opinion/'), F.col("cited").cast("string"), F.lit('/"'), title, F.lit(">"), F.col("label"), F.lit("</a>"))
    chip = F.when(F.col("scoped"), page).otherwise(F.concat(F.lit('<span class="cited-case"'), title, F.lit(">"), F.col("label"), F.lit("</span>")))
    alone = F.when(F.col("cited").isNull(), F.col("label")).otherwise(F.concat(F.lit('<span class="cited-case-wrap">'), chip, F.lit("</span>")))
    if authorities is None:
        return rows.withColumn("link", alone).drop("scoped")
    about = authorities.select("cluster_id", "n", F.struct("name", "page_url", "overall_severity").alias("info"))
    rows = rows.join(about, ["cluster_id", "n"], "left")
    name = F.coalesce(filled(F.col("info.name")), F.col("case"))
    shown = F.concat(F.lit('<span class="cited-case'), F.when(F.col("manual"), " cited-case--added").otherwise(""), F.lit('">'), F.col("label"), F.lit("</span>"))
    icon = F.coalesce(F.element_at(map_of([(t, marker(t)) for t in ICONS]), F.col("info.overall_severity")), F.lit(""))
    n = F.col("n").cast("string")
    row = F.concat(F.lit('<a class="cited-case-wrap" href="#authority-'), n, F.lit('"'), _titled(name), F.lit(' data-group="'), n, F.lit('" data-name="'), escape_html(name), F.lit('" data-url="'), escape_html(F.coalesce("info.page_url", F.lit(""))), F.lit('">'), shown, icon, F.lit("</a>"))
    bare = F.concat(F.lit('<span class="cited-case">'), F.col("label"), F.lit("</span>"))
    return rows.withColumn("link", F.when(F.col("n").isNull(), alone).when(F.col("info").isNull(), bare).otherwise(row)).drop("scoped", "info")


def spliced(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` with the link of each citation in place of its tag."""
    listed = links.groupBy(*SEGMENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "link"))), lambda x: x["link"]).alias("_links"))
    pieces = F.split("html", TAG, -1)
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("_links", i), F.lit("")))), "")
    return parts.join(listed, SEGMENT, "left").withColumn("html", whole).drop("_links")


def bodies(opinions: DataFrame, authorities: DataFrame | None = None) -> DataFrame:
    """(cluster_id, body): the html of each opinion's text: a section for each writing,
    with its heading, typed blocks and notes that lead back to their marks."""
    parts = segments(opinions)
    parts = spliced(parts, linked(spans(parts), opinions, authorities)).withColumn("html", balanced_udf("html"))
    lit, kind = F.lit, F.when(F.col("type").isin(*BLOCK_TAGS), F.col("type")).otherwise("paragraph")
    tag, cls = (F.element_at(map_of([(t, x[j]) for t, x in BLOCK_TAGS.items()]), kind) for j in (0, 1))
    block = F.concat(lit("<"), tag, F.when(cls == "", "").otherwise(F.concat(lit(' class="'), cls, lit('"'))), lit(">"), F.col("html"), lit("</"), tag, lit(">"))
    label = escape_html(F.col("label"))
    note = F.concat(lit('<li id="'), F.col("id"), lit('"><span class="fn-label"><a class="fn-label__link" href="#'), F.col("ref_id"), lit('" aria-label="Back to reference '), label, lit('">'), label, lit('</a></span><div class="fn-body"><p>'), F.col("html"), lit("</p></div></li>"))
    rows = parts.select("cluster_id", "w", "title", "k", "note", F.when(F.col("note"), note).otherwise(block).alias("piece"))
    of = lambda note: F.array_join(F.transform(F.filter("_all", lambda x: x["note"] == lit(note)), lambda x: x["piece"]), "")
    whole = rows.groupBy("cluster_id", "w").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("k", "note", "piece"))).alias("_all"))
    titled = F.coalesce(F.col("title"), lit("")) != ""
    number = F.concat(lit("writing-"), F.col("w").cast("string"))
    anchor, data_id = F.when(titled, section_anchor(F.col("title"))).otherwise(number), F.when(titled, escape_html(F.col("title"))).otherwise(number)
    notes = F.when(of(True) == "", "").otherwise(F.concat(lit('<aside class="opinion-footnotes" aria-label="Footnotes"><h3 class="opinion-heading opinion-heading--notes">Footnotes</h3><ol>'), of(True), lit("</ol></aside>")))
    section = F.concat(lit('<section id="'), anchor, lit('" data-section-id="'), data_id, lit('">'), F.when(titled, F.concat(lit("<h2>"), escape_html(F.col("title")), lit("</h2>"))).otherwise(""), of(False), notes, lit("</section>"))
    sections = whole.select("cluster_id", F.struct("w", section.alias("html")).alias("s"))
    return sections.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["html"]), "\n").alias("body"))


def text_bodies(opinions: DataFrame, authorities: DataFrame | None = None) -> DataFrame:
    """H13 for text documents: (cluster_id, body) from ``document``, as ``string_document``
    returns it: what stands before the first section is bare, sections have their headings,
    and a section without a paragraph keeps its heading."""
    parts = segments(opinions)
    parts = spliced(parts, linked(spans(parts), opinions, authorities))
    shown = parts.select("cluster_id", "w", F.struct("k", F.concat(F.lit("<p>"), "html", F.lit("</p>")).alias("html")).alias("p"))
    pieces = shown.groupBy("cluster_id", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["html"]), "\n").alias("html"))
    held = pieces.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "html"))).alias("_of"))
    inner = lambda i: F.coalesce(F.element_at("_of", i + 1), F.lit(""))
    section = lambda x, i: F.when(x["title"].isNull(), inner(i)).otherwise(F.concat(F.lit('<section id="'), section_anchor(x["title"]), F.lit('" data-section-id="'), escape_html(x["title"]), F.lit('"><h2>'), escape_html(x["title"]), F.lit("</h2>"), inner(i), F.lit("</section>")))
    return opinions.join(held, "cluster_id", "left").select("cluster_id", F.array_join(F.transform("document", section), "\n").alias("body"))
