"""A small corpus on disk, through the source to pages; and the registered queries."""

import json

import __spark_entry__
import pytest
from juriscope.operators import edges, later_courts
from juriscope.plans import site
from juriscope.plans.queries import QUERIES
from juriscope.sources import json_corpus, sinks

OPINIONS = [
    ("anchor_opinions", 1, "Smith v. Jones", "cand", "FD", "2010-01-01"),
    ("authorities", 2, "Smith v. Jones", "ca9", "F", "2011-01-01"),
    ("citing_opinions", 3, "Jones v. Smith", "scotus", "F", "2012-06-01"),
    ("citing_opinions_round2", 4, "People v. Doe", "cal", "S", "2013-01-01"),
    ("citing_opinions", 1, "Smith v. Jones", "cand", "FD", "2010-01-01"),
]
ACTS = {
    2: [(1, "1 U.S. 1", "Affirmed by", [])],
    3: [(2, "2 U.S. 1", "Reversed by", [])],
    4: [(2, "2 U.S. 1", "Distinguished by", [{"treatment": "Reversed by", "severity": "Stop", "acting_case": "the United States Supreme Court"}])],
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for folder, cid, name, court, code, date in OPINIONS:
        (root / folder).mkdir(exist_ok=True)
        html = "<p>The court speaks at length about nothing. We find Smith inapposite here, it said.</p>"
        (root / folder / f"{cid}.json").write_text(json.dumps({"cluster_id": cid, "case_name": name, "docket_number": f"No. {cid}", "citations": [f"{cid} U.S. 1"], "court": court, "court_full_name": f"Court {court}", "court_jurisdiction": code, "date_filed": date, "opinions": [{"id": 100 + cid, "type": "020lead", "author": "", "html": html}]}))
    for name in ("citation_groups", "treatments"):
        (root / name).mkdir()
    for cid, rows in ACTS.items():
        groups = [{"gid": str(n), "n": n, "name": "", "cl_name": None, "citations": [cite], "cited_as": [], "n_mentions": 2} for n, (_, cite, _, _) in enumerate(rows, 1)]
        (root / "citation_groups" / f"{cid}.json").write_text(json.dumps({"opinions": [], "groups": groups, "occurrences": {}}))
        treated = {str(n): {"applied": label, "severity": "x", "quote": "We find Smith inapposite" if cid == 4 else "", "recognized": rec} for n, (_, _, label, rec) in enumerate(rows, 1)}
        (root / "treatments" / f"{cid}.json").write_text(json.dumps({"treatments": treated, "gold": {}, "disposition": {"label": "Reversed"}, "on_appeal": []}))
    (root / "citing_counts_authorities.json").write_text(json.dumps({"per_authority": {"1": {"total": 5, "controlling": 2}}}))
    (root / "citing_counts_citing.json").write_text(json.dumps({"per_authority": {"1": {"total": 7, "controlling": 3}}}))
    (root / "citing_edges.csv").write_text("citing_cluster_id,anchor_opinion_id\n2,101\n")
    return json_corpus.load_source("json", spark, str(root))


def test_load(corpus):
    ops = {r.cluster_id: r for r in corpus.opinions.collect()}
    assert sorted(ops) == [1, 2, 3, 4] and ops[1].tier == "anchor" and ops[1].document[0].title is None  # one writing has no title
    found = {(r.citing, r.cited, r.treatment): r for r in corpus.edges.collect()}
    assert set(found) == {(2, 1, "Affirmed by"), (3, 2, "Reversed by"), (4, 2, "Distinguished by"), (4, 2, "Reversed as recognized by")}
    assert found[2, 1, "Affirmed by"].scope == "controlling" and found[3, 2, "Reversed by"].scope == "collection"
    assert corpus.counts.head().total == 7
    level = {r.court: (r.level, r.last_resort) for r in corpus.courts.collect()}
    assert level["cal"] == (1, True) and level["scotus"] == (0, True) and level["cand"] == (2, False)


def test_status_of_the_reversed_opinion(corpus):
    views = edges.joined(corpus.edges, corpus.opinions, corpus.courts)
    assert {r.verdict for r in views.collect()} == {"ok"}
    s = {r.cluster_id: r for r in later_courts.statuses(later_courts.rows(edges.valid(views)), corpus.opinions, corpus.courts).collect()}
    assert (s[2].on_appeal_state, s[2].on_appeal_citing_name, s[2].dh_severity, s[2].cr_severity) == ("treated", "Jones v. Smith", "Stop", "Caution")
    assert s[3].on_appeal_state == "not_reviewable" and s[4].later_state == "none" and s[1].later_state == "none"


def test_pages_and_sinks(spark, corpus, tmp_path):
    pages = {r.cluster_id: r for r in site.pages(corpus).collect()}
    assert [x.citing for x in pages[2].cited_by] == [3, 4] or len(pages[2].cited_by) == 2
    assert pages[4].cited_authorities[0].treatment_active == "Distinguishes" and pages[1].excerpt.startswith("The court speaks")
    # The chain: three courts act on one another, and a card of the act that a fourth reports.
    grid = pages[1].history
    assert [(x.node, x.role) for x in grid] == [(1, "self"), (2, "above"), (3, "above")] and not grid[0].has_reported
    assert [[[y.treatment for y in a] for a in x.acts or []] for x in grid] == [[], [["Affirms"]], [["Reverses"]]]
    assert [x.col for x in grid] == [3, 4, 5] and pages[4].history is None
    assert pages[1].body == '<section id="writing-1" data-section-id="writing-1"><p>The court speaks at length about nothing. We find Smith inapposite here, it said.</p></section>'
    # The passage of a status is the leading act's, checked against the citing opinion's text.
    assert (pages[2].later_citing, pages[2].later_quote, pages[2].later_quote_status, pages[2].later_authority_n) == (4, "We find Smith inapposite", "found", 1)
    assert (pages[2].on_appeal_citing, pages[2].on_appeal_quote, pages[2].on_appeal_quote_status) == (3, "", "")
    cited = corpus.opinions.selectExpr("cluster_id AS cited", "citations", "case_name")
    shown = {r.citing: r for r in site.with_quotes(corpus.edges.filter("acting_case = ''").join(cited, "cited"), corpus.opinions, "citing", "citations", "case_name").collect()}
    assert shown[4].quote == "We find Smith inapposite here, it said." and shown[4].quote_status == "found" and shown[4].quote_names == "name" and shown[3].quote_status == ""
    sinks.write_opinions(corpus.opinions.drop("document"), str(tmp_path / "o"))
    assert sinks.read_opinions(spark, str(tmp_path / "o")).count() == 4
    sinks.write_side_tables(spark, corpus.courts, str(tmp_path / "side"))
    assert spark.read.json(str(tmp_path / "side" / "treatments")).count() == 4


@pytest.mark.parametrize("name", ["later_courts_status", "edges_all", "home_search", "verify_quote", "html_blocks"])
def test_registered_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_every_key_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
