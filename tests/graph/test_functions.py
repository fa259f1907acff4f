"""Label algebra, text keys, courts, quotes and documents on literal values."""

from juriscope.functions import courts, documents, quotes, text
from juriscope.functions import taxonomy as tax
from juriscope.operators.search import SearchParams
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head()


L = F.lit


def test_labels(spark):
    row = one(spark, tax.past(L("Overruled as recognized by")), tax.recognized_form(L("Overruled by")), tax.active(L("Reversed as recognized by")), tax.active(L("Extended by")), tax.severity(L("Extended by")), tax.recorded_severity(L("Extended by"), L("Caution")), tax.rank(L(None)), tax.direction(L("Affirmed by")), tax.recognizes(L("Cert. denied by")))
    assert tuple(row) == ("Overruled", "Overruled as recognized by", "Recognizes as reversed", "Extended", "Other", "Caution", 4, "Direct History", "Recognizes to be cert. denied")
    assert one(spark, tax.worst(F.array(L("Neutral"), L(None), L("Warning"), L("Odd"))), tax.worst(F.array().cast("array<string>"), "none"))[:] == ("Warning", "none")
    table = {r.severity: r for r in tax.treatment_table(spark).collect()}
    assert table["Caution"].direct_history == ["Remanded by", "Cert. granted by"] and table["Stop"].citing_reference == ["Overruled by", "Abrogated by"]
    forms = {r.form: r.definition for r in tax.definitions(spark).collect()}
    assert len(forms) == 95 and forms["Reverses"] == "On direct appeal, this case reversed the decision below."
    assert forms["Recognizes to be overruled"] == "This case noted that another case expressly overruled all or part of the cited case."


def test_pill_states(spark):
    def states(expert, *pills):
        p = F.array(*[F.struct(L(k).alias("kind"), L(t).alias("treatment"), L(s).alias("severity")) for k, t, s in pills])
        return one(spark, tax.pill_states(p, L(expert).cast("string")))[0]

    over, cited, dist = ("applied", "Overruled by", "Stop"), ("applied", "Cited by", "Neutral"), ("recognized", "Distinguished by", "Caution")
    assert states(None, over) == ["unverified"]
    assert states("Overruled by", over, dist) == ["agree", "unverified"]
    assert states("Overruled as recognized by", over) == ["disagree"]
    assert states("Distinguished by", cited, over) == ["unverified", "unverified"]
    assert states("Criticized by", over, dist) == ["disagree", "unverified"]
    assert states("Criticized as recognized by", cited, dist) == ["unverified", "disagree"]
    assert states("Affirmed by", over) == ["unverified"]
    assert one(spark, tax.row_state(F.array(L("agree"), L("disagree"))))[0] == "disagree"


def test_court_relations(spark):
    rows = [("scotus", 0, "scotus", "Supreme Court"), ("ca9", 1, "circuit", "Ninth Circuit"), ("cand", 2, "district", "N.D. California"), ("ord", 2, "district", "D. Oregon"), ("cal", 1, "state_supreme", "California Supreme Court"), ("calapp", 2, "state_appellate", "Cal. Ct. App."), ("wva", 1, "state_supreme", "West Virginia"), ("x", None, None, "?"), ("y", None, None, "??")]
    c = courts.with_state(spark.createDataFrame(rows, "court string, level int, category string, display string"))
    side = lambda p: c.select(*[F.col(n).alias(p + n) for n in c.columns])
    got = {(r.cited_court, r.citing_court): r.rel for r in side("cited_").crossJoin(side("citing_")).withColumn("rel", courts.relation("cited_", "citing_")).collect()}
    for cited, citing, want in [("cand", "cand", "equal"), ("cand", "scotus", "controlling"), ("scotus", "ca9", "other"), ("cand", "ca9", "controlling"), ("ca9", "cand", "other"), ("cand", "ord", "equal"), ("calapp", "cal", "controlling"), ("cal", "wva", "other"), ("cand", "cal", "other"), ("x", "y", "equal"), ("cal", "scotus", "controlling")]:
        assert got[cited, citing] == want, (cited, citing)
    assert {r.court: r.state for r in c.collect()}["wva"] == "West Virginia"


def test_picker_ends_with_other(spark):
    rows = [("scotus", "Supreme", 0, "scotus"), ("cadc", "D.C.", 1, "circuit"), ("ca10", "Tenth", 1, "circuit"), ("ca2", "Second", 1, "circuit"), ("t", "Texas trial", 3, "state_trial"), ("s", "Texas top", 1, "state_supreme"), ("o", "Tribal", 2, None)]
    got = courts.court_picker(spark.createDataFrame(rows, "court string, display string, level int, category string")).orderBy("tab_ord", "group_ord", "court_ord").collect()
    assert [r.key for r in got] == ["scotus", "ca2", "ca10", "cadc", "s", "t", "o"]
    assert got[-1].tab == "other" and got[5].depth == 1 and got[0].n_courts == 4


def test_text_keys(spark):
    row = one(spark, text.short_date(L("2010-03-04")), text.short_date(L("2010")), text.docket_numbers(L("11-393, 11-398; 1")), text.cite_key(L("103 F.3d 888, 890")), text.short_name(L("Smith & Co. v. Jones")), text.section_anchor(L("Dissent (Kagan)")), text.act_verbs(L("Affirmed in part; Reversed in part")), text.clean_authority_name(L("Troppi v Scarf (leave denied)")), text.display_name(L(" "), F.array(L("1 U.S. 2")), L("")))
    assert tuple(row) == ("03/04/2010", "2010", ["11-393", "11-398", "1"], "103f3d888", "smithco", "section-Dissent-Kagan", ["affirmed", "reversed"], "Troppi v Scarf", "Unnamed opinion (1 U.S. 2)")
    cites = F.array(*map(L, ["5 L. Ed. 2d 3", "9 WL 1", "1 F.3d 2", "3 U.S. 4", "2 F. Supp. 2d 9"]))
    assert one(spark, text.order_citations(cites))[0] == ["3 U.S. 4", "1 F.3d 2", "2 F. Supp. 2d 9", "5 L. Ed. 2d 3", "9 WL 1"]


def test_case_groups(spark):
    none = F.array().cast("array<string>")
    for form, want in [("633 F.3d 894", True), ("591 U. S. ___", True), ("82 F.4th at", True), ("Bruton", True), ("In re Google", True), ("Id. at 405", False), ("42 U.S.C. § 1983", False), ("see supra", False), ("12 Harv. L. Rev. 3", False), ("the plaintiff moved", False)]:
        assert one(spark, text.is_case_group(L(""), L(None).cast("string"), F.array(L(form)), none))[0] is want, form


def test_dispositions_and_below(spark):
    t = lambda a, b: one(spark, text.disposition_treatment(L(a), L(b)))[0]
    assert t("Affirmed", "x")[:] == ("Affirmed by", "Neutral", "") and t("Modified", "")[:] == ("Ordered by", "Neutral", "Modified") and t("Other", "") is None
    entries = F.array(*[F.struct(L(c).alias("court"), L(n).alias("name")) for c, n in [("", ""), ("ct", ""), ("", "People v. Roe"), ("", "Smith matter")]])
    assert one(spark, text.below_entry(entries, L("Smith v. State")))[0].name == "Smith matter"
    assert one(spark, text.below_entry(entries, L("Doe v. State")))[0].name == "People v. Roe"
    c = lambda x: tuple(one(spark, text.canonical_court(L(x)))[0])
    assert c("the United States  Supreme Court")[0] == "scotus" and c("Ninth Circuit") == ("ca9", "Court of Appeals for the Ninth Circuit") and c(" a  court ") == ("", "a court")


BODY = "We begin here. The rule of Smith v. Jones, 5 U.S. 1, is that every agency must explain itself fully. Id. at 3. That ends the matter, as the S.D. court said."


def test_quotes():
    s = quotes.sentence_bounds(BODY, BODY.index("agency"), BODY.index("agency") + 6)
    assert BODY[slice(*s)].strip() == "The rule of Smith v. Jones, 5 U.S. 1, is that every agency must explain itself fully."
    assert quotes.expand([BODY], "every agency must explain") == BODY[slice(*s)].strip()
    assert quotes.expand([BODY], "words that stand nowhere in it") == "words that stand nowhere in it"
    streams = [quotes.Stream(quotes.tokens(BODY))]
    assert quotes.verify(streams, "is that every agency must explain")[0] == "found"
    assert quotes.verify(streams, "We begin")[0] == "short"
    assert quotes.verify(streams, "That ends the matter as the court. The rule of Smith v Jones 5 U.S. 1 is that.")[0] in ("stitched", "partial")
    assert quotes.verify(streams, "nothing like this was ever written anywhere")[0] == "missing"
    assert quotes.mark("In Smith & 5 U. S. 1, 3", ["5 U.S. 1 2"], "Smithson v. X").count("<strong") == 0
    assert quotes.mark("See 525 U.S. 10 <b>", ["525 U.S. 10, 12"], "") == 'See <strong class="evidence-card__case">525 U.S. 10</strong> &lt;b&gt;'


def test_headings_and_blocks():
    assert [documents.is_heading(x) for x in ("I", "II. ANALYSIS", "BACKGROUND", "a. Diminution in value", "It is so ordered.", "14. An officer's personal knowledge of facts and circumstances, in", "Plain words here")] == [True, True, True, True, False, False, False]
    source = '<opinion type="dissent"><author>KAGAN, J.</author><p>took no part.</p><h3>I</h3><p>See <span class="citation" data-id="9"><a href="/opinion/12/x/" aria-description="Citation for case: A v. B">1 U.S. 2</a></span><footnotemark>1</footnotemark> and <em>more</em>.</p><page-number>*3</page-number><footnote label="1"><p>1. A note.</p></footnote></opinion>'
    blocks, notes, kind = documents.structured(source)
    assert kind == "dissent" and [b["type"] for b in blocks] == ["author", "heading", "paragraph"]
    assert blocks[0]["html"] == "KAGAN, J. took no part." and '<citedCase data-cluster-id="12" data-case="A v. B">1 U.S. 2</citedCase>' in blocks[2]["html"]
    assert notes[0]["label"] == "1"
    doc = documents.document([{"id": "a", "type": "020lead", "author": "", "html": source}, {"id": "b", "type": "", "author": "", "html": source}])
    assert [w["title"] for w in doc] == ["Dissent", "Dissent 2"] and doc[1]["footnotes"][0]["id"] == "fn-2-1"
    dump = "<pre class='inline'>\n          BACKGROUND\n    First line of a paragraph that goes on for more than sixty char-\nacters in all.\n\n 3\n    Second.\n</pre>"
    assert [(b["type"], b["html"]) for b in documents.dumped(dump)] == [("heading", "BACKGROUND"), ("paragraph", "First line of a paragraph that goes on for more than sixty characters in all."), ("paragraph", "Second.")]
    known = documents.cite_map([source.replace("1 U.S. 2", "1 U.S. 2, 5")])
    assert known == {"1 U.S. 2, 5": ("12", "A v. B"), "1 U.S. 2": ("12", "A v. B")}
    assert documents.inject("in 1 U.S. 2, and 11 U.S. 2", known).count("<citedCase") == 1
    assert documents.add_mentions(["<em>Smith</em> and Smith & Smith"], "<em>Smith</em> and Smith & Smith", [("Smith", 1, "4", "", 2)])[0].index("<citedCase") == 19
    assert documents.balanced("<em>a</strong><b>c</em>") == "<em>a<b>c</b></em>"


def test_search_state_round_trip():
    p = SearchParams("103 F.3d", ("ca9", "cand"), ("stop",), (), False, 2)
    assert SearchParams.parse(p.query()) == p and SearchParams.parse("") == SearchParams()
    assert p.toggled(("ca9",)).courts == ("cand",) and p.toggled(("ca9", "x")).courts == ("ca9", "cand", "x") and p.box(("ca9", "x")) == "some"
