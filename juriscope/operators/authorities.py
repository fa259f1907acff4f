"""Authorities rows: what an opinion does to the cases it cites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juriscope.functions import courts as court_fn
from juriscope.functions import taxonomy as tax
from juriscope.functions.text import docket_numbers, filled, name_order, or_empty, search_text
from juriscope.operators import hubs
from juriscope.operators.later_courts import court_order


def rows(groups: DataFrame, opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """C1 without quotes: P3, P14, P15, J9, L14, L15, A2 for each citation group.

    ``groups``: cluster_id, n, cited_cluster_id, name, cited_as, citations, court,
    treatment, severity, quote, rationale, treatment_other_label, expert_treatment,
    n_mentions, date_filed_iso, recognized (array of treatment, severity, quote, rationale)."""
    g = groups.filter(~F.coalesce(F.col("cited_cluster_id") == F.col("cluster_id"), F.lit(False)))
    own = opinions.select("cluster_id", F.col("court").alias("own_court"))
    known = opinions.select(F.col("cluster_id").alias("cited_cluster_id"), F.col("court").alias("known_court"), F.col("docket_number").alias("known_docket"), F.col("is_scoped").alias("known_scoped"))
    g = g.join(own, "cluster_id", "left").join(known, "cited_cluster_id", "left")
    g = g.withColumns({"court": F.coalesce(filled(F.col("court")), filled(F.col("known_court")), F.lit("")), "treatment": F.coalesce(filled(F.col("treatment")), F.lit(tax.PLAIN))})
    dims = court_fn.with_state(courts).select("court", "level", "category", "jurisdiction", "state")
    for side, key in (("citing_", "court"), ("cited_", "own_court")):
        g = g.join(dims.select(F.col("court").alias(key), *[F.col(c).alias(side + c) for c in dims.columns[1:]]), key, "left").withColumn(f"{side}court", F.col(key))
    some = lambda c: F.coalesce(filled(c), F.lit("Neutral"))
    ranked = F.array_sort(F.transform(F.filter(F.coalesce("recognized", F.array()), lambda r: r.isNotNull()), lambda r, i: F.struct(tax.rank(r["severity"]).alias("rank"), i.alias("at"), or_empty(r["treatment"]).alias("treatment"), some(r["severity"]).alias("severity"), or_empty(r["quote"]).alias("quote"), or_empty(r["rationale"]).alias("rationale"))))
    g = g.withColumn("recognized", ranked)
    tiers = F.transform("recognized", lambda r: r["severity"])
    pills = F.concat(F.array(F.struct(F.lit("applied").alias("kind"), F.col("treatment"), some(F.col("severity")).alias("severity"))), F.transform("recognized", lambda r: F.struct(F.lit("recognized").alias("kind"), r["treatment"].alias("treatment"), r["severity"].alias("severity"))))
    g = g.withColumn("states", tax.pill_states(pills, F.col("expert_treatment")))
    shown = tax.has_evidence(F.col("treatment"))
    card = lambda order, at, t, s, label, other, why, quote: F.struct(order.alias("order"), tax.rank(s).alias("rank"), at.alias("at"), t.alias("treatment"), s.alias("severity"), label.alias("label"), other.alias("other_label"), why.alias("rationale"), quote.alias("quote"))
    applied = card(F.when(F.col("treatment").isin(tax.DIRECT), 0).otherwise(1), F.lit(-1), F.col("treatment"), some(F.col("severity")), tax.active(F.col("treatment")), or_empty(F.col("treatment_other_label")), or_empty(F.col("rationale")), or_empty(F.col("quote")))
    reported = lambda r, i: card(F.lit(2), i, tax.recognized_form(r["treatment"]), r["severity"], tax.recognizes(r["treatment"]), F.lit(""), F.when((r["rationale"] == "") & (i == 0) & ~shown, or_empty(F.col("rationale"))).otherwise(r["rationale"]), r["quote"])
    cards = F.array_sort(F.filter(F.concat(F.array(applied), F.transform("recognized", reported)), lambda c: tax.has_evidence(c["treatment"])))
    return g.withColumn("evidence_cards", cards).select(
        "cluster_id",
        "n",
        "cited_cluster_id",
        or_empty(F.col("name")).alias("name"),
        "court",
        F.col("citing_level").alias("court_level"),
        court_fn.relation("cited_", "citing_").alias("court_relation"),
        "treatment",
        tax.active(F.col("treatment")).alias("treatment_active"),
        F.col("severity"),
        F.coalesce("known_scoped", F.lit(False)).alias("is_scoped"),
        F.when(F.col("known_scoped"), F.concat(F.lit("/opinion/"), F.col("cited_cluster_id").cast("string"), F.lit("/"))).otherwise("").alias("page_url"),
        docket_numbers(F.col("known_docket")).alias("docket_numbers"),
        search_text(F.col("name"), F.concat(F.coalesce("cited_as", F.array().cast("array<string>")), F.coalesce("citations", F.array().cast("array<string>")))).alias("search_text"),
        "recognized",
        tax.worst(tiers).alias("recognized_severity"),
        tax.worst(tiers, "none").alias("recognized_filter"),
        tax.worst(F.concat(F.array(some(F.col("severity"))), tiers)).alias("overall_severity"),
        (F.col("n") - 1).alias("appearance_index"),
        F.concat(F.lit("auth-"), F.col("n").cast("string")).alias("row_id"),
        F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"),
        or_empty(F.col("date_filed_iso")).alias("date_filed_iso"),
        "evidence_cards",
        F.exists("evidence_cards", lambda c: (c["quote"] != "") | (c["rationale"] != "")).alias("has_detail"),
        F.get("states", F.lit(0)).alias("applied_validation"),
        F.slice("states", 2, F.greatest(F.size("states") - 1, F.lit(0))).alias("recognized_validation"),
        tax.row_state(F.col("states")).alias("validation"),
    )


def ranks(authorities: DataFrame, most: int = hubs.HUB) -> DataFrame:
    """Each row's place within its opinion under every sort key; an opinion of more
    than ``most`` rows is placed in ranges."""
    severity, recognized, overall = (tax.rank(F.col(c)).asc() for c in ("severity", "recognized_severity", "overall_severity"))
    others = {
        "severity_index": [overall, severity, recognized, F.col("n").asc()],
        "date_index": [(F.col("date_filed_iso") == "").asc(), F.col("date_filed_iso").desc()],
        "name_index": [name_order(F.col("name")).asc()],
        "mentions_index": [F.col("n_mentions").desc()],
        "court_index": [court_order(F.col("court_relation"), F.col("court_level"), F.col("name")).asc()],
    }
    return hubs.places(authorities, "cluster_id", "n", ("dom_index", [severity, recognized, F.col("n").asc()]), others, most)


def meta(groups: DataFrame) -> DataFrame:
    """Authorities and mentions of each opinion."""
    return groups.groupBy("cluster_id").agg(F.count("*").alias("n_authorities"), F.coalesce(F.sum("n_mentions"), F.lit(0)).alias("n_mentions"))
