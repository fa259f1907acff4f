"""The source of fixtures, text documents, and whole builds."""

import re
from html import escape

import pytest
from juriscope.functions.documents import markdown_paragraphs, string_document
from juriscope.operators import citations
from juriscope.plans import build
from juriscope.sources import fixtures, json_corpus, publish
from pyspark.sql import functions as F


def test_fixtures_are_read_in_partitions(spark):
    t = fixtures.tables(spark, partitions=3)
    assert {k: v.count() for k, v in t.items()} == {"opinions": 10, "external": 39, "edges": 59}
    assert t["edges"].rdd.getNumPartitions() == 3
    rows = sorted(map(tuple, t["edges"].collect()))
    assert rows == [fixtures.edge(e, fixtures.SIZES) for e in range(59)] == sorted(map(tuple, fixtures.tables(spark, partitions=100)["edges"].collect()))
    more = fixtures.tables(spark, pages=1, external=0, edges=0)
    assert [more[k].count() for k in ("opinions", "external", "edges")] == [1, 0, 0]
    with pytest.raises(Exception, match="no table"):
        spark.read.format("juriscope_fixtures").option("table", "courts").load()


def test_sources_by_name(spark):
    with pytest.raises(ValueError):
        json_corpus.load_source("nothing", spark, "")
    spark.conf.set(json_corpus.SOURCE_CONF, "fixtures")
    try:
        corpus = json_corpus.load_source(None, spark, "")
    finally:
        spark.conf.unset(json_corpus.SOURCE_CONF)
    assert corpus.opinions.count() == 49 and corpus.opinions.filter("is_scoped").count() == 10


def slow_body(text):
    """A text document's html by hand; citations have neither groups nor pages here."""

    def paragraphs(part):
        out = []
        for p in (x.strip() for x in part.strip().split("\n\n")):
            if p:
                bits = re.split(r"<citedCase[^>]*>(.+?)</citedCase>", p)
                out.append("<p>" + "".join(escape(b) for b in bits) + "</p>")
        return "\n".join(out)

    bits = re.split(r"(?m)^##\s+(.+?)\s*$", (text or "").strip())
    out = [paragraphs(bits[0])] if bits[0].strip() else []
    for title, part in zip(bits[1::2], bits[2::2], strict=True):
        name = re.sub("[^A-Za-z0-9]+", "-", title).strip("-")
        out.append(f'<section id="{"section-" + name if name else ""}" data-section-id="{escape(title)}"><h2>{escape(title)}</h2>{paragraphs(part)}</section>')
    return "\n".join(out)


TEXTS = [
    None,
    "",
    " \n\n ",
    "Only a paragraph.",
    "A <b> & 'c'.\n\n\n\nSecond\nline.\n\n \n\nThird.",
    '## "Quoted" & more\n\nText <citedCase>5 U.S. <1></citedCase> end <citedCase data-case="x">b</citedCase>',
    "Before.\n## One\nRight below.\n\n## Two  \n\n## Three\n\n\n",
    "## !!\n\nNo letters.\n#### Not a section\n ## nor this",
    "##Tight\n\n## Open\n\n<citedCase>a</citedCase><citedCase>b</citedCase>",
    "x" * 50_000 + "\n\n## End\n\n" + "y z " * 20_000,
]


def test_text_documents(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "cluster_id long, text string").select("cluster_id", F.lit(True).alias("is_scoped"), string_document(F.col("text")).alias("document"), markdown_paragraphs(F.col("text")).alias("plain"))
    got = {r.cluster_id: r.body for r in citations.text_bodies(frame).collect()}
    assert got == {i: slow_body(t) for i, t in enumerate(TEXTS)}
    plain = {r.cluster_id: r.plain for r in frame.collect()}
    assert plain[4] == ["A <b> & 'c'.", "Second\nline.", "Third."] and plain[5] == ["Text 5 U.S. <1> end b"] and plain[0] is None and plain[2] == []


def test_two_builds(spark, tmp_path):
    out = str(tmp_path / "site")
    first = build.build(spark, "", out, "fixtures", {"preview": "0", "notes": "yes"})
    assert (first["version"], first["added"], first["same"]) == (1, 10, 0) and sum(first["edges"].values()) == 59
    dates = [r.date_filed for r in spark.read.json(f"{out}/index").select("date_filed", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()]
    assert len(dates) == 10 and dates == sorted(dates, reverse=True)
    assert spark.read.json(f"{out}/side/scope").head().opinions == 10
    assert publish.page(spark, f"{out}/pages", 1003).head().court == "scotus"
    pages = {r.cluster_id: r for r in publish.read(spark, f"{out}/pages").collect()}
    assert sorted(pages) == list(range(1001, 1011))
    # No groups, so no Authorities rows; links lead to pages of the collection.
    one, two = pages[1001], pages[1002]
    assert all(p.cited_authorities is None for p in pages.values())
    assert '<a class="cited-case" href="/opinion/1001/" title="Alder">' in two.body and "&lt;before the full bench&gt;" in one.body
    assert [s.title for s in one.sections] == ["Opinion of the Court", "Dissent"] and one.body.startswith("<p>Argued in term 1")
    citing = {e[1] for e in (fixtures.edge(e, fixtures.SIZES) for e in range(59)) if e[2] == 1001}
    assert {r.citing for r in one.cited_by} <= citing and len(one.cited_by) > 9
    quoted = {r.citing: r.lead_quote_status for r in one.cited_by if r.lead_quote}
    assert quoted and set(quoted.values()) == {"found"}
    second = build.build(spark, "", out, "fixtures")
    assert (second["version"], second["added"], second["changed"], second["same"], second["removed"]) == (2, 0, 0, 10, 0)
