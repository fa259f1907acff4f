"""Later Courts rows, their ranks, and the status of an opinion.

A row stands for one citing opinion of one cited opinion and holds its treatments
as pills.  Whatever a row or a status needs is an arg-min under an explicit key,
so aggregations combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.functions import taxonomy as tax
from juriscope.functions.text import docket_numbers, filled, name_order, or_empty, search_text, short_date
from juriscope.operators import hubs


def rows(views: DataFrame) -> DataFrame:
    """One row for each (cited, citing) pair of valid edges."""
    pill = F.struct(
        tax.rank(F.col("severity")).alias("rank"),
        "edge_ord",
        F.when(tax.is_recognized(F.col("treatment")), "recognized").otherwise("applied").alias("kind"),
        "treatment",
        "severity",
        "direction",
        F.col("expert_treatment"),
        or_empty(F.col("quote")).alias("quote"),
        or_empty(F.col("rationale")).alias("rationale"),
        or_empty(F.col("acting_case")).alias("acting_case"),
    )
    head = F.struct("citing_case_name", "citing_court_display", "citing_level", "citing_date_filed", "relation", "citing_citations", "citing_docket_number", "citing_is_scoped", "authority_n", "n_mentions")
    grouped = views.groupBy("cited", "citing").agg(F.min("edge_ord").alias("first_ord"), F.min_by(head, "edge_ord").alias("h"), F.array_sort(F.collect_list(pill)).alias("pills"))
    of = lambda kind: F.filter("pills", lambda p: p["kind"] == kind)
    grouped = grouped.withColumns({"applied": of("applied"), "recognized": of("recognized")})
    grouped = grouped.withColumn("shown", F.concat("applied", "recognized"))
    lead = F.get("shown", F.lit(0))
    # Validation sees the pills by severity, with applied ones first at equal severity.
    ordered = F.array_sort(F.transform("shown", lambda p, i: F.struct(p["rank"].alias("rank"), i.alias("at"), p["kind"].alias("kind"), tax.base(p["treatment"]).alias("treatment"), p["severity"].alias("severity"))))
    grouped = grouped.withColumns({"lead": lead, "_ordered": ordered})
    grouped = grouped.withColumn("states", tax.pill_states(F.col("_ordered"), F.col("lead.expert_treatment")))
    cards = F.filter("shown", lambda p: tax.has_evidence(p["treatment"]))
    tiers = lambda c: F.transform(c, lambda p: p["severity"])
    return grouped.select(
        "cited",
        "citing",
        "first_ord",
        F.col("h.citing_case_name").alias("case_name"),
        F.col("h.citing_court_display").alias("court_display"),
        F.col("h.citing_level").alias("court_level"),
        F.col("h.citing_date_filed").alias("date_filed"),
        short_date(F.col("h.citing_date_filed")).alias("date_short"),
        F.col("h.relation").alias("relation"),
        docket_numbers(F.col("h.citing_docket_number")).alias("docket_numbers"),
        search_text(F.col("h.citing_case_name"), F.col("h.citing_citations")).alias("search_text"),
        F.col("h.citing_is_scoped").alias("is_scoped"),
        F.col("h.authority_n").alias("authority_n"),
        F.coalesce("h.n_mentions", F.lit(0)).alias("n_mentions"),
        F.col("lead.treatment").alias("treatment"),
        F.col("lead.direction").alias("direction"),
        F.col("lead.expert_treatment").alias("expert_treatment"),
        tax.worst(tiers("shown")).alias("severity"),
        tax.worst(tiers("recognized"), "none").alias("recognized_filter"),
        "applied",
        "recognized",
        F.transform("_ordered", lambda p, i: F.struct(p["kind"].alias("kind"), p["treatment"].alias("treatment"), F.get("states", i).alias("validation"))).alias("validated"),
        tax.row_state(F.col("states")).alias("validation"),
        cards.alias("evidence_cards"),
        F.exists(cards, lambda p: (p["quote"] != "") | (p["rationale"] != "")).alias("has_detail"),
        F.col("lead.quote").alias("lead_quote"),
    )


def court_order(relation: Column, level: Column, name: Column) -> Column:
    standing = F.when(relation.isin("controlling", "equal"), 0).otherwise(1)
    return F.struct(standing.alias("standing"), F.coalesce(level, F.lit(99)).alias("level"), name_order(name).alias("name"))


def dom_order() -> list[Column]:
    """O2: severity, newest first, first seen."""
    return [tax.rank(F.col("severity")).asc(), F.col("date_filed").desc(), F.col("first_ord").asc()]


def ranks_of(keys: DataFrame, most: int = hubs.HUB) -> DataFrame:
    """``ranks`` of rows that have their keys: rank, day, first_ord, name, n_mentions,
    standing, level; a day may be any number that grows with the date."""
    newest = [F.col("day").isNull().asc(), F.col("day").desc()]
    others = {"severity_index": [F.col("rank").asc(), *newest], "recency_index": newest, "name_index": [F.col("name").asc()], "mentions_index": [F.col("n_mentions").desc()], "court_index": [F.col("standing").asc(), F.col("level").asc(), F.col("name").asc()]}
    return hubs.places(keys, "cited", "citing", ("dom_index", [F.col("rank").asc(), F.col("day").desc(), F.col("first_ord").asc()]), others, most)


def ranks(later: DataFrame, most: int = hubs.HUB) -> DataFrame:
    """Each row's place within its cited opinion under every sort key. An opinion
    that more than ``most`` others cite is placed in ranges."""
    newest = [(or_empty(F.col("date_filed")) == "").asc(), F.col("date_filed").desc()]
    others = {
        "severity_index": [tax.rank(F.col("severity")).asc(), *newest],
        "recency_index": newest,
        "name_index": [name_order(F.col("case_name")).asc()],
        "mentions_index": [F.col("n_mentions").desc()],
        "court_index": [court_order(F.col("relation"), F.col("court_level"), F.col("case_name")).asc()],
    }
    return hubs.places(later, "cited", "citing", ("dom_index", dom_order()), others, most)


def _act(direct: bool) -> Column:
    """The first act of a row that is (or isn't) direct history: worst first,
    the court's own before a report."""
    fits = F.filter(F.concat("applied", "recognized"), lambda p: tax.is_direct(p["treatment"]) == F.lit(direct))
    keyed = F.transform(fits, lambda p, i: F.struct(p["rank"].alias("rank"), tax.is_recognized(p["treatment"]).alias("reported"), i.alias("at"), p["treatment"].alias("treatment"), p["severity"].alias("severity")))
    return F.array_min(keyed)


def statuses(later: DataFrame, opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """One row for each scoped opinion: what happened on appeal, how later
    courts treat it, and the two tiers that filters read. L16: its passage is that of the
    row's leading act, whichever act is shown. ``lead_quote_status``, where ``later`` has it,
    goes with it."""
    if "lead_quote_status" not in later.columns:
        later = later.withColumn("lead_quote_status", F.lit(""))
    return statuses_of(later.withColumns({"own": _act(True), "cr": _act(False), "row_rank": tax.rank(F.col("severity")), "age": F.expr("-unix_date(cast(date_filed as date))")}), opinions, courts)


def statuses_of(acts: DataFrame, opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """``statuses`` of rows that have their acts: own and cr (rank, reported, treatment,
    severity), row_rank, age, first_ord, relation and what is told of the citing opinion."""
    place = lambda act: F.struct(F.col(f"{act}.rank").alias("rank"), F.col(f"{act}.reported").alias("reported"), "row_rank", "age", "first_ord")
    about = lambda act: F.struct(F.col(f"{act}.treatment").alias("treatment"), F.col(f"{act}.severity").alias("severity"), F.col("case_name").alias("citing_name"), F.col("court_display").alias("citing_court"), "citing", F.col("lead_quote").alias("quote"), F.col("lead_quote_status").alias("quote_status"), "authority_n")
    has = lambda act: F.col(act).isNotNull()
    negative = has("cr") & tax.is_negative(F.col("cr.severity"))
    lead_key = F.struct(F.when(F.col("relation").isin("controlling", "equal"), 0).otherwise(1).alias("standing"), place("cr").alias("place"))
    per = acts.groupBy(F.col("cited").alias("cluster_id")).agg(
        F.count("*").alias("n_rows"),
        F.min_by(F.when(has("own"), about("own")), F.when(has("own"), place("own"))).alias("appeal"),
        F.min_by(F.when(negative, about("cr")), F.when(negative, lead_key)).alias("lead"),
        F.min_by(F.when(has("cr"), about("cr")), F.when(has("cr"), place("cr"))).alias("first_later"),
        F.count_if(has("cr")).alias("n_later"),
        F.count_if(negative).alias("n_negative"),
    )
    own = opinions.filter("is_scoped").join(courts.select("court", F.coalesce("last_resort", F.lit(False)).alias("last_resort")), "court", "left")
    s = own.select("cluster_id", "tier", F.coalesce("last_resort", F.lit(False)).alias("last_resort")).join(per, "cluster_id", "left")
    populated = (F.col("tier") == "anchor") | (F.coalesce("n_rows", F.lit(0)) > 0)
    scope = F.when(F.col("tier") == "anchor", "controlling").otherwise("collection")
    appeal, lead = F.col("appeal"), F.col("lead")
    n_later, n_negative = (F.coalesce(c, F.lit(0)) for c in ("n_later", "n_negative"))
    return s.select(
        "cluster_id",
        scope.alias("scope"),
        F.when(appeal.isNotNull(), "treated").when(F.col("last_resort"), "not_reviewable").when(populated, "none").otherwise("unknown").alias("on_appeal_state"),
        *[appeal[c].alias(f"on_appeal_{c}") for c in ("treatment", "severity", "citing_name", "citing", "quote", "quote_status", "authority_n")],
        F.when(lead.isNotNull(), "negative").when(n_later > 0, "plain").when(populated | (scope == "collection"), "none").otherwise("unknown").alias("later_state"),
        *[lead[c].alias(f"later_{c}") for c in ("treatment", "severity", "citing_name", "citing_court", "citing", "quote", "quote_status", "authority_n")],
        F.when(lead.isNotNull(), n_negative - 1).alias("n_other_negative"),
        F.when(lead.isNotNull(), n_later - n_negative).alias("n_plain"),
        F.when(n_later > 0, n_later).alias("n_total"),
        appeal["severity"].alias("dh_severity"),
        F.coalesce(lead["severity"], F.col("first_later.severity")).alias("cr_severity"),
    )


def page_state(populated: Column, n_rows: Column, total: Column) -> Column:
    """The Later Courts tab: a list, or why it is empty."""
    return F.when(n_rows > 0, "list").when(populated, "none").when(total.isNotNull(), "counts").otherwise("unknown")


def unnamed_filter(x: Column) -> Column:
    """P20: a tier as a filter value."""
    return F.lower(F.coalesce(filled(x), F.lit("none")))
