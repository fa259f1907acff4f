"""Search, filters, sort switches and paging over index entries and row lists."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriscope.functions import taxonomy as tax
from juriscope.functions.text import alnum, or_empty

PAGE = 10


@dataclass(frozen=True)
class SearchParams:
    """The state of a search and its query string."""

    q: str = ""
    courts: tuple[str, ...] = ()
    dh_sev: tuple[str, ...] = ()
    cr_sev: tuple[str, ...] = ()
    anchors_only: bool = True
    page: int = 0

    @staticmethod
    def parse(query: str) -> "SearchParams":
        got = {k: v[-1] for k, v in parse_qs(query.lstrip("?")).items()}
        many = lambda k: tuple(x for x in got.get(k, "").split(",") if x)
        tiers = lambda k: tuple(x for x in many(k) if x in [t.lower() for t in tax.TIERS])
        page = int(got["page"]) if got.get("page", "").isdigit() else 1
        return SearchParams(got.get("q", ""), many("courts"), tiers("dh_sev"), tiers("cr_sev"), got.get("anchors") != "0", max(page, 1) - 1)

    def query(self) -> str:
        parts = {"q": self.q, "courts": ",".join(self.courts), "dh_sev": ",".join(self.dh_sev), "cr_sev": ",".join(self.cr_sev), "anchors": "" if self.anchors_only else "0", "page": str(self.page + 1) if self.page else ""}
        return urlencode({k: v for k, v in parts.items() if v})

    def toggled(self, keys: tuple[str, ...]) -> "SearchParams":
        """SO7: selects a court, group or tab, or clears it when all of it is selected."""
        chosen = tuple(c for c in self.courts if c not in keys) if set(keys) <= set(self.courts) else tuple(dict.fromkeys([*self.courts, *keys]))
        return SearchParams(self.q, chosen, self.dh_sev, self.cr_sev, self.anchors_only, 0)

    def box(self, keys: tuple[str, ...]) -> str:
        """SO7: what a group's check box shows."""
        n = len(set(keys) & set(self.courts))
        return "none" if not n else "all" if n == len(set(keys)) else "some"


def tier_hit(tier: Column, wanted: tuple[str, ...]) -> Column:
    return F.lower(F.coalesce(tier, F.lit("none"))).isin(list(wanted)) if wanted else F.lit(False)


def told_apart(p: SearchParams) -> Column:
    """P17 as far as the opinion itself tells: tier, court and search_text."""
    key = "".join(c for c in p.q.lower() if c.isascii() and c.isalnum())
    cond = F.lit(True)
    if p.anchors_only:
        cond &= F.col("tier") == "anchor"
    if p.courts:
        cond &= F.col("court").isin(list(p.courts))
    return cond & F.contains("search_text", F.lit(key)) if key else cond


def row_matches(p: SearchParams) -> Column:
    """On columns tier, court, dh_severity, cr_severity, search_text."""
    if not p.dh_sev and not p.cr_sev:
        return told_apart(p)
    return told_apart(p) & (tier_hit(F.col("dh_severity"), p.dh_sev) | tier_hit(F.col("cr_severity"), p.cr_sev))


def index_order() -> list[Column]:
    """O1: named opinions first, newest first, by name, in load order."""
    return [F.col("name_missing").asc(), (or_empty(F.col("date_filed")) == "").asc(), F.col("date_filed").desc(), F.lower("case_name").asc(), F.col("load_ord").asc()]


def search(index: DataFrame, p: SearchParams, size: int = PAGE) -> DataFrame:
    """The rows of one page, with page_index, in index order. A top-k sort:
    no task holds more than the pages up to this one."""
    hits = index.filter(row_matches(p)).orderBy(*index_order()).offset(p.page * size).limit(size)
    return hits.withColumn("page_index", F.row_number().over(Window.orderBy(*index_order())) - 1 + p.page * size)


def counts(index: DataFrame, p: SearchParams, size: int = PAGE) -> DataFrame:
    """Visible and total rows, pages, the page held to them, and its label."""
    n = index.agg(F.count_if(row_matches(p)).alias("visible"), F.count("*").alias("total"))
    n = n.withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("visible") / size)).cast("long"))
    n = n.withColumn("page", F.least(F.lit(p.page), F.col("page_count") - 1).cast("long"))
    first = F.col("page") * size + 1
    label = F.concat(first.cast("string"), F.lit("–"), F.least(F.col("visible"), first + size - 1).cast("string"), F.lit(" of "), F.col("visible").cast("string"))
    return n.withColumn("label", F.when(F.col("visible") == 0, "No opinions match").otherwise(label))


def list_visible(q: str = "", applied: tuple[str, ...] = (), recognized: tuple[str, ...] = (), validation: tuple[str, ...] = ()) -> Column:
    """On columns search_text, applied_filter, recognized_filter, validation."""
    key = "".join(c for c in q.lower() if c.isascii() and c.isalnum())
    cond = F.contains("search_text", F.lit(key)) if key else F.lit(True)
    if applied or recognized:
        cond &= tier_hit(F.col("applied_filter"), applied) | tier_hit(F.col("recognized_filter"), recognized)
    return cond & F.col("validation").isin(list(validation)) if validation else cond


#: The column behind each sort key; an unknown key leaves the default.
SORTS = {
    "authorities": {"severity": "severity_index", "appearance": "appearance_index", "date": "date_index", "name": "name_index", "mentions": "mentions_index", "court": "court_index"},
    "later": {"severity": "severity_index", "recency": "recency_index", "name": "name_index", "mentions": "mentions_index", "court": "court_index"},
}


def sort_column(tab: str, key: str) -> str:
    return SORTS[tab].get(key, SORTS[tab]["severity"])


def court_visible(q: Column, display: Column) -> Column:
    """Whether a court's name holds the typed text."""
    return F.contains(F.lower(display), F.lower(F.trim(q)))


def group_visible(q: Column, name: Column, displays: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", F.concat_ws(" ", displays), name)), F.lower(F.trim(q)))


def court_summary(selected: Column, display: Column) -> Column:
    """What the court box says."""
    return F.when(selected == 0, "All courts").when(selected == 1, display).otherwise(F.concat(selected.cast("string"), F.lit(" courts")))


def scope_counts(index: DataFrame, n_courts: int) -> DataFrame:
    """Opinions by tier, the anchors' years, and forms for display."""
    anchor, tier = F.col("tier") == "anchor", F.col("tier")
    year = F.when(anchor & (or_empty(F.col("date_filed")) != ""), F.substring("date_filed", 1, 4))
    n = index.agg(
        F.count("*").alias("opinions"),
        F.count_if(anchor).alias("anchors"),
        F.count_if(tier == "authority").alias("authorities"),
        F.count_if(tier == "citing").alias("citing"),
        F.lit(n_courts).cast("long").alias("courts"),
        or_empty(F.min(year)).alias("anchor_earliest_year"),
        or_empty(F.max(year)).alias("anchor_latest_year"),
    )
    return n.withColumns({f"{c}_display": F.format_number(c, 0) for c in ("opinions", "authorities", "citing")})


def mentions(marks: DataFrame) -> DataFrame:
    """Each mark's place among the mentions of its authority; marks: cluster_id, n, pos."""
    of = Window.partitionBy("cluster_id", "n")
    return marks.withColumns({"occurrence": F.row_number().over(of.orderBy("pos")), "total": F.count("*").over(of)})


def lead_card(cards: Column) -> Column:
    """The most serious card, the first of equal ones; an unknown first card stays."""
    keyed = F.transform(cards, lambda c, i: F.struct(F.when((i == 0) & (tax.rank(c["severity"]) == 4), -1).otherwise(tax.rank(c["severity"])).alias("rank"), i.alias("at")))
    return F.get(cards, F.array_min(keyed)["at"])


def search_key(x: Column) -> Column:
    return alnum(x)
