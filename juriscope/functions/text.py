"""Keys, names, dates, citations and dispositions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from juriscope.functions import taxonomy
from juriscope.functions.literals import array_of, map_of

# A procedural tag at the end of an authority's name.
ROLE_TAG = (
    r"(?i)\s*\((?:cert(?:iorari)?\.?\s*(?:granted|denied|dismissed|grant|denial)|"
    r"leave\s+(?:denied|granted)|lv\.?\s*den\.?|writ\s+(?:denied|refused|granted)|review\s+(?:denied|granted)|"
    r"appeal(?:\s+(?:denied|dismissed|granted))?|rehearing(?:\s+denied)?|probable jurisdiction noted|"
    r"affirmed(?:\s+in\s+part\s+and\s+reversed\s+in\s+part)?|affirmance(?:\s+order)?|aff'?d|"
    r"(?:reversed|rev'?d)(?:\s+on\s+other\s+grounds)?|vacated(?:\s+and\s+remanded)?|modified|remanded|"
    r"order|reargument\s+order|\d{4}|on appeal|trial below|trial court|prior round|companion|related|"
    r"court of appeals|state court|district court|lower court|supreme court|"
    r"(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|d\.c\.|federal)\s+circuit)\)\s*$"
)
# Forms of a citation to a case, of a short name, of "id.", and of citations to no case.
REPORTER_CITE = r"^\d+\s+[A-Za-z(][A-Za-z0-9.'’()&\s-]*?,?\s+(?:\d+|_{2,}|at\b)"
SHORT_NAME = r"^(?:[A-Z][A-Za-z'’.&-]*|v\.|re|of|the|In|ex|rel\.)(?: (?:[A-Z][A-Za-z'’.&-]*|v\.|re|of|the|ex|rel\.|II|III|IV|V)){0,4}$"
ID_FORM = r"(?i)^(?:see (?:also )?)?(?:id|ibid)\b|\bsupra\b"
NON_CASE = r"(?i)U\. ?S\. ?C\.|§|C\. ?F\. ?R\.|\bStat\.|Fed\. ?Reg\.|Pub\. ?L\.|L\. ?Rev\.|L\. ?J\.|J\. ?(?:Const|Legal|L)\.|Law Journal"
# Reporters in the order that a citation list shows them.
REPORTERS = [
    r"^\d+ U\.S\. \d",
    r"^\d+ F\.(?: ?[234]d| ?4th)? \d",
    r"^\d+ F\. ?Supp\.(?: ?[23]d)? \d",
    r"^\d+ F\. ?App'x \d",
    r"^\d+ (?:[NS]\.[EW]\.|A\.|P\.|So\.|Cal\.|N\.Y\.|Ill\.|Mass\.|Pa\.|Ohio St\.|Wash\.|Tex\.|Mich\.)(?: ?[2345]d| ?[2345]th)? \d",
    r"^\d+ S\. ?Ct\. \d",
    r"^\d+ L\. ?Ed\.(?: ?2d)? \d",
    r"^\d+ (?:U\.S\. App\. D\.C\.|B\.R\.|Fed\. Cl\.|T\.C\.|Vet\. App\.) \d",
]
# Words too common to tell a case by.
STOP_WORDS = (
    "v vs in re the of and ex rel et al state states united people commonwealth inc co corp llc ltd company city county "
    "board dept department commissioner director secretary estate matter application petition appeal"
).split()
# Circuits as prose names them.
CIRCUIT_WORDS = {
    "first": "ca1", "second": "ca2", "third": "ca3", "fourth": "ca4", "fifth": "ca5", "sixth": "ca6",
    "seventh": "ca7", "eighth": "ca8", "ninth": "ca9", "tenth": "ca10", "eleventh": "ca11",
    "d.c.": "cadc", "d. c.": "cadc", "dc": "cadc", "federal": "cafc",
}
CIRCUIT = r"\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|d\.\s?c\.|dc|federal)\s+circuit\b"
SCOTUS = r"(united states|u\.\s?s\.)\s+supreme court|supreme court of the united states|\bscotus\b"
SCOTUS_NAMES = ["supreme court of the united states", "united states supreme court"]


def filled(x: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(x, F.lit(""))


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(or_empty(x)), "[^a-z0-9]+", "")


def short_date(x: Column) -> Column:  # T1
    parts = F.split(x, "-")
    return F.when(or_empty(x) == "", "").when(F.size(parts) == 3, F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(0)))).otherwise(x)


def docket_numbers(x: Column) -> Column:  # T2
    return F.filter(F.transform(F.split(or_empty(x), r"[,;]\s*"), lambda x: F.trim(x)), lambda d: d != "")


def search_text(name: Column, citations: Column) -> Column:  # T3
    return alnum(F.concat(or_empty(name), F.lit(" "), F.array_join(F.coalesce(citations, F.array().cast("array<string>")), " ")))


def cite_key(x: Column) -> Column:  # T4
    return alnum(F.substring_index(x, ",", 1))


def short_name(x: Column) -> Column:
    """T5: the first party of a case name, letters and digits only."""
    return alnum(F.regexp_replace(or_empty(x), r"(?s)\s+v\.?\s+.*$", ""))


def quote_name_key(x: Column) -> Column:
    key = short_name(x)
    return F.when(F.length(key) >= 5, key).otherwise("")


def cite_keys(citations: Column) -> Column:  # T6
    return F.filter(F.transform(citations, cite_key), lambda k: F.length(k) >= 5)


def name_order(x: Column) -> Column:
    """Sorts names by letters and digits, unnamed ones last."""
    clean = F.trim(F.regexp_replace(F.lower(or_empty(x)), "[^a-z0-9 ]+", " "))
    return F.struct(((clean == "") | F.startswith(clean, F.lit("unnamed opinion"))).alias("last"), clean.alias("name"))


def newest_first(date: Column) -> list[Column]:
    return [(or_empty(date) == "").asc(), date.desc()]


def section_anchor(title: Column) -> Column:  # T8
    slug = F.regexp_replace(F.regexp_replace(or_empty(title), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "").otherwise(F.concat(F.lit("section-"), slug))


def case_name_from_aria(label: Column) -> Column:  # T9
    return F.trim(F.regexp_replace(F.regexp_replace(or_empty(label), r"^\s*Citation for case:\s*", ""), r"\s+", " "))


def escape_html(x: Column, quotes: bool = True) -> Column:  # T11
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def excerpt(paragraphs: Column) -> Column:
    """The first long paragraph that lists no counsel, cut at a sentence's end."""
    counsel = r"(?s)\bAttorneys? for\b|\b(?:LLP|LLC|PLLC|P\.\s?C\.)\b.*\b(?:Suite|Street|Avenue|Road)\b"
    first = F.coalesce(F.get(F.filter(paragraphs, lambda p: (F.length(p) >= 120) & ~p.rlike(counsel)), F.lit(0)), F.get(paragraphs, F.lit(0)), F.lit(""))
    head = F.substring(first, 1, 280)
    at = F.when(F.locate(" .", F.reverse(head), 1) > 0, F.length(head) - F.locate(" .", F.reverse(head), 1) - 1).otherwise(F.lit(-1))
    cut = F.when(at > 168, F.substr(head, F.lit(1), at + 1)).otherwise(F.concat(F.rtrim(head), F.lit("…")))
    return F.when(F.length(first) <= 280, first).otherwise(cut)


def case_name_words(x: Column) -> Column:  # T15
    words = F.regexp_extract_all(F.lower(or_empty(x)), F.lit("[a-z]+"), F.lit(0))
    return F.filter(F.array_except(words, array_of(STOP_WORDS)), lambda w: F.length(w) > 2)


def clean_authority_name(x: Column) -> Column:  # P5
    return F.trim(F.regexp_replace(or_empty(x), ROLE_TAG, ""))


def is_case_group(name: Column, cl_name: Column, cited_as: Column, citations: Column) -> Column:  # P1
    none = F.array().cast("array<string>")
    forms = F.filter(F.concat(F.coalesce(cited_as, none), F.coalesce(citations, none)), lambda f: ~f.rlike(ID_FORM))
    named = F.trim(F.coalesce(filled(name), filled(cl_name), F.lit(""))) != ""
    a_case = lambda f: (F.trim(f).rlike(REPORTER_CITE) & ~F.trim(f).rlike(NON_CASE)) | F.trim(f).rlike(SHORT_NAME)
    return named | F.exists(forms, a_case)


def other_forms(cited_as: Column, citations: Column, name: Column) -> Column:
    """The forms a case is cited in, but for its name."""
    forms = F.when(F.size(F.coalesce(cited_as, F.array().cast("array<string>"))) > 0, cited_as).otherwise(F.coalesce(citations, F.array().cast("array<string>")))
    return F.filter(forms, lambda f: f != name)


def display_name(name: Column, citations: Column, docket: Column) -> Column:  # P16
    return (
        F.when(F.trim(or_empty(name)) != "", F.trim(name))
        .when(F.size(citations) > 0, F.concat(F.lit("Unnamed opinion ("), F.get(citations, F.lit(0)), F.lit(")")))
        .when(F.trim(or_empty(docket)) != "", F.concat(F.lit("Unnamed opinion (No. "), F.trim(docket), F.lit(")")))
        .otherwise("Unnamed opinion")
    )


def order_citations(citations: Column) -> Column:
    """Primary reporters first, the others in their own order."""

    def place(c: Column) -> Column:
        out = F.lit(len(REPORTERS))
        for i in range(len(REPORTERS) - 1, -1, -1):
            out = F.when(c.rlike(REPORTERS[i]), i).otherwise(out)
        return out

    ranked = F.array_sort(F.transform(citations, lambda c, i: F.struct(place(c).alias("rank"), i.alias("at"), c.alias("cite"))))
    return F.transform(ranked, lambda r: r["cite"])


def disposition_treatment(label: Column, text: Column) -> Column:
    """struct(treatment, severity, text) of what an opinion did with its case, or null."""
    label, text = F.trim(or_empty(label)), F.trim(or_empty(text))
    treatment = F.concat(label, F.lit(" by"))
    as_struct = lambda t, s, x: F.struct(t.alias("treatment"), s.alias("severity"), x.alias("text"))
    named = F.array_contains(array_of(taxonomy.LABELS), treatment)
    ordered = (text != "") | ~label.isin("", "None", "Other")
    return F.when(named, as_struct(treatment, taxonomy.severity(treatment), F.lit(""))).when(ordered, as_struct(F.lit("Ordered by"), F.lit("Neutral"), F.coalesce(filled(text), label)))


def disposition_label(label: Column, text: Column) -> Column:  # D2
    found = disposition_treatment(label, text)
    return F.when(found.isNotNull(), F.struct(taxonomy.active(found["treatment"]).alias("label"), found["text"].alias("text")))


def below_entry(on_appeal: Column, case_name: Column) -> Column:
    """Which decision below an opinion reviewed: the entry that shares a telling
    word with its name, else the first named one, else the first."""
    entries = F.filter(on_appeal, lambda e: (or_empty(e["court"]) != "") | (or_empty(e["name"]) != ""))
    own = case_name_words(case_name)
    pick = lambda f: F.get(F.filter(entries, f), F.lit(0))
    return F.coalesce(pick(lambda e: F.arrays_overlap(own, case_name_words(e["name"]))), pick(lambda e: or_empty(e["name"]) != ""), F.get(entries, F.lit(0)))


def act_verbs(label: Column) -> Column:
    """The acts that a label names, as a set."""
    parts = F.split(F.lower(label), r"[;,]|\band\b")
    verbs = F.transform(parts, lambda w: F.trim(F.replace(F.replace(w, F.lit("in part"), F.lit("")), F.lit("by"), F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(verbs, lambda v: v != "")))


def names_supreme_court(x: Column) -> Column:
    return F.contains(F.lower(x), F.lit(SCOTUS_NAMES[0])) | F.contains(F.lower(x), F.lit(SCOTUS_NAMES[1]))


def canonical_court(x: Column, scotus_display: str = "Supreme Court of the United States", displays: dict[str, str] | None = None) -> Column:
    """struct(court, name) of a court named in prose."""
    prose = F.trim(F.regexp_replace(or_empty(x), r"\s+", " "))
    low = F.lower(prose)
    word = F.regexp_replace(F.regexp_extract(low, CIRCUIT, 1), r"\s+", " ")
    court = F.element_at(map_of(CIRCUIT_WORDS.items()), word)
    known = F.element_at(map_of((displays or {"": ""}).items()), court)
    name = F.coalesce(filled(known), F.concat(F.lit("Court of Appeals for the "), F.initcap(F.regexp_replace(word, r"d\.c\.", "d.c.")), F.lit(" Circuit")))
    name = F.when(word.isin("d.c.", "d. c."), F.coalesce(filled(known), F.concat(F.lit("Court of Appeals for the "), F.upper(word), F.lit(" Circuit")))).otherwise(name)
    pair = lambda a, b: F.struct(a.alias("court"), b.alias("name"))
    return F.when(low.rlike(SCOTUS), pair(F.lit("scotus"), F.lit(scotus_display))).when(word != "", pair(court, name)).otherwise(pair(F.lit(""), prose))


def quote_names_case(quote: Column, citations: Column, name: Column) -> Column:
    """Q5: whether a quote names the case by a citation, by its name, or not at all."""
    reduced, key = alnum(quote), quote_name_key(name)
    return F.when(F.exists(cite_keys(citations), lambda k: F.contains(reduced, k)), "cite").when((key != "") & F.contains(reduced, F.substring(key, 1, 12)), "name").otherwise("")


def tokens(x: Column) -> Column:
    """Q4: a text's words: tags and star pages dropped, letters and digits only."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(or_empty(x), r"<[^>]+>", " "), r"\*\d+", " "), r"\s+", " ")
    return F.filter(F.split(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def page_link(cluster_id: Column, authority_n: Column, quote: Column, quote_status: Column) -> Column:
    """The deep link to an authority row, else to the quote, else to the page."""
    page = F.concat(F.lit("/opinion/"), cluster_id.cast("string"), F.lit("/"))
    by_quote = F.concat(page, F.lit("#q="), F.replace(F.url_encode(quote), F.lit("+"), F.lit("%20")))
    return F.when(authority_n.isNotNull(), F.concat(page, F.lit("#authority-"), authority_n.cast("string"))).when((or_empty(quote) != "") & (or_empty(quote_status) != "missing"), by_quote).otherwise(page)


def first_items(xs: Column, n: int = 3) -> Column:
    """struct(shown, more): the first ``n`` of a list and how many are left."""
    return F.struct(F.slice(xs, 1, n).alias("shown"), F.greatest(F.size(xs) - n, F.lit(0)).alias("more"))
