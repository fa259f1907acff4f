"""Links of citations and bodies of pages against a splice by hand."""

import html
import random
import re

import pytest
from juriscope.functions import documents
from juriscope.operators import citations

DOCUMENT = "cluster_id long, is_scoped boolean, document " + documents.DOCUMENT
ROWS = {(1, 1): ("Ox & \"Ash\" v. Elm", "/opinion/7/", "Stop"), (1, 2): ("", "", "Neutral"), (1, 3): ("Fir", "", "Caution"), (2, 1): ("Oak", "/opinion/1/", None)}
SCOPED = {1, 2, 7}


def by_hand(cluster, fragment, with_rows):
    def one(m):
        a, label = dict(re.findall('([a-z-]+)="([^"]*)"', m[1])), m[2]
        n, cited, case = int(a["data-group"]) if "data-group" in a else None, a.get("data-cluster-id"), a.get("data-case", "")
        if n is not None and with_rows:
            if (cluster, n) not in ROWS:
                return f'<span class="cited-case">{label}</span>'
            name, url, tier = ROWS[cluster, n]
            name = html.escape(name or case)
            title = f' title="{name}"' if name else ""
            added = " cited-case--added" if "data-manual" in a else ""
            icon = citations.marker(tier) if tier in citations.ICONS else ""
            return f'<a class="cited-case-wrap" href="#authority-{n}"{title} data-group="{n}" data-name="{name}" data-url="{url}"><span class="cited-case{added}">{label}</span>{icon}</a>'
        if not cited:
            return label
        title = f' title="{html.escape(case)}"' if case else ""
        inner = f'<a class="cited-case" href="/opinion/{cited}/"{title}>{label}</a>' if int(cited) in SCOPED else f'<span class="cited-case"{title}>{label}</span>'
        return f'<span class="cited-case-wrap">{inner}</span>'

    return documents.balanced(re.sub("<citedCase([^>]*)>(.+?)</citedCase>", one, fragment))


def fragment(rng):
    out = []
    for _ in range(rng.randrange(6)):
        tag = documents.cited_case(rng.choice(["5 U.S. 1", "Ox & Ash", "a < b"]), rng.choice([None, "1", "7", "9"]), rng.choice(["", "Ox & \"A\""]), rng.choice([None, 1, 2, 3, 4]), rng.random() < 0.3)
        out.append(rng.choice([tag, tag, " plain &amp; ", "<em>", "</em>", "$1 \\\\ "]))
    return "".join(out)


@pytest.mark.parametrize("with_rows", [True, False])
def test_bodies_against_a_splice_by_hand(spark, with_rows):
    rng, rows, want = random.Random(5), [], {}
    for cluster in (1, 2, 3, 4):
        doc, shown = [], []
        for w in range(1, rng.randrange(1, 4) + 1):
            title = rng.choice([None, "", "Dissent (Roe & Co.)"])
            blocks = [{"type": rng.choice(["paragraph", "heading", "author", "odd", "blockquote"]), "html": fragment(rng)} for _ in range(rng.randrange(1, 5))]
            notes = [{"label": str(k), "html": fragment(rng), "id": f"fn-{w}-{k}", "ref_id": f"fnref-{w}-{k}"} for k in range(rng.randrange(3))]
            doc.append({"title": title, "blocks": blocks, "footnotes": notes})
            anchor, name = ("section-Dissent-Roe-Co", html.escape(title)) if title else (f"writing-{w}", f"writing-{w}")
            parts = [f"<h2>{name}</h2>"] if title else []
            for b in blocks:
                tag, cls = citations.BLOCK_TAGS.get(b["type"], ("p", ""))
                parts.append(f"<{tag}" + (f' class="{cls}"' if cls else "") + f">{by_hand(cluster, b['html'], with_rows)}</{tag}>")
            items = [f'<li id="{n["id"]}"><span class="fn-label"><a class="fn-label__link" href="#{n["ref_id"]}" aria-label="Back to reference {n["label"]}">{n["label"]}</a></span><div class="fn-body"><p>{by_hand(cluster, n["html"], with_rows)}</p></div></li>' for n in notes]
            if items:
                parts.append('<aside class="opinion-footnotes" aria-label="Footnotes"><h3 class="opinion-heading opinion-heading--notes">Footnotes</h3><ol>' + "".join(items) + "</ol></aside>")
            shown.append(f'<section id="{anchor}" data-section-id="{name}">{"".join(parts)}</section>')
        rows.append((cluster, cluster in SCOPED, doc))
        want[cluster] = "\n".join(shown)
    rows += [(7, True, None), (9, False, [])]
    frame = spark.createDataFrame(rows, DOCUMENT).repartition(3)
    auth = spark.createDataFrame([(c, n, *v) for (c, n), v in ROWS.items()], "cluster_id long, n int, name string, page_url string, overall_severity string")
    assert {r.cluster_id: r.body for r in citations.bodies(frame, auth if with_rows else None).collect()} == want


def test_loaded_documents_carry_their_groups(spark):
    """Occurrences, groups and further mentions of a cluster reach its document, and the
    citations of the payload's html a text that was read anew."""
    from pyspark.sql import functions as F

    span = '<span class="citation"><a href="/opinion/7/x/" aria-description="Citation for case: Ox v. Ash">5 U.S. 1</a></span>'
    writing = "array<struct<id:string,type:string,author:string,html:string>>"
    rows = [
        (1, [("a", "", "", f"<p>See {span} and Ox.</p>")], True, {"a:0": "g"}, [("g", 4, "7", "Ox v. Ash")], [("a", "Ox", 0, "g")], []),
        (2, [("b", "", "", "<p>See 5 U.S. 1 too.</p>")], False, None, None, None, [("5 U.S. 1", "7", "Ox v. Ash")]),
        (3, None, False, None, None, None, None),
    ]
    schema = f"cluster_id long, writings {writing}, seeded boolean, occ map<string,string>, groups array<struct<gid:string,n:int,cluster:string,name:string>>, manual array<struct<op_id:string,text:string,nth:int,group:string>>, known array<struct<cite:string,target:string,case_name:string>>"
    frame = spark.createDataFrame(rows, schema).withColumn("occ", F.map_entries("occ"))
    found = {r.cluster_id: r.d for r in frame.select("cluster_id", documents.document_udf("writings", "seeded", "occ", "groups", "manual", "known").alias("d")).collect()}
    first, second = (documents.marks(found[k][0].blocks[0].html) for k in (1, 2))
    assert [(m["n"], m["cluster_id"], m["label"], m["manual"]) for m in first] == [(4, "7", "5 U.S. 1", False), (4, "7", "Ox", True)]
    assert [(m["n"], m["cluster_id"], m["label"]) for m in second] == [(None, "7", "5 U.S. 1")] and found[3] is None
