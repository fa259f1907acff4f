"""Edge construction, validation and adjacency of the treatment graph.

The graph is a table of edges: edge_ord (any orderable value that fixes the order
of all edges), citing, cited, treatment and what the citing opinion says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriscope.functions import courts as court_fn
from juriscope.functions import taxonomy as tax
from juriscope.functions.literals import array_of
from juriscope.functions.text import filled, or_empty

EDGE = ["edge_ord", "citing", "cited", "treatment", "source", "expert_treatment", "quote", "rationale", "acting_case", "authority_n", "n_mentions", "scope"]


def scope_pairs(scope: DataFrame, opinions: DataFrame) -> DataFrame:
    """Distinct (citing, cited) pairs of the citing scope. ``scope`` names an
    anchor by a writing's id or by its cluster; unknown anchors go."""
    anchors = opinions.filter("tier = 'anchor'")
    alias = anchors.select(F.explode(F.array_union(F.array("cluster_id"), F.coalesce("opinion_ids", F.array().cast("array<bigint>")))).alias("alias"), F.col("cluster_id").alias("cited"), "load_ord")
    last = alias.groupBy("alias").agg(F.max_by("cited", "load_ord").alias("cited"))
    named = scope.select(F.col("citing_cluster_id").alias("citing"), F.coalesce("anchor_opinion_id", "anchor_cluster_id").alias("alias"))
    return named.join(last, "alias").select("citing", "cited").distinct()


def build(groups: DataFrame, opinions: DataFrame, controlling: DataFrame) -> DataFrame:
    """E1, A10, P4, SO2, J11: one applied edge for each (citing, cited) pair, from its
    first group, and one edge for every recognized treatment.

    ``groups``: cluster_id, load_ord, n, cited_cluster_id, treatment, source,
    expert_treatment, quote, rationale, n_mentions, recognized (array of struct)."""
    scoped = opinions.select(F.col("cluster_id").alias("cited")).distinct()
    usable = groups.withColumnRenamed("cluster_id", "citing").withColumnRenamed("cited_cluster_id", "cited")
    usable = usable.filter("cited is not null and cited <> 0 and cited <> citing").join(scoped, "cited", "left_semi")
    flagged = usable.join(controlling.select("citing", "cited", F.lit("controlling").alias("scope")), ["citing", "cited"], "left").withColumn("scope", F.coalesce("scope", F.lit("collection")))
    first = F.row_number().over(Window.partitionBy("citing", "cited").orderBy("load_ord", "n")) == 1

    def edge(kind: int, pos: Column, treatment: Column, source: Column, expert: Column, quote: Column, rationale: Column, acting: Column) -> Column:
        fields = {"edge_ord": F.struct("load_ord", "n", F.lit(kind).alias("kind"), pos.cast("int").alias("pos")), "treatment": treatment, "source": source, "expert_treatment": expert.cast("string"), "quote": or_empty(quote), "rationale": or_empty(rationale), "acting_case": acting}
        return F.struct(*[x.alias(name) for name, x in fields.items()])

    own = edge(0, F.lit(0), F.coalesce(filled(F.col("treatment")), F.lit(tax.PLAIN)), F.coalesce(filled(F.col("source")), F.lit("model")), filled(F.col("expert_treatment")), F.col("quote"), F.col("rationale"), F.lit(""))
    labelled = F.transform(F.coalesce("recognized", F.array()), lambda r, i: F.struct(i.alias("pos"), F.trim(or_empty(r["treatment"])).alias("label"), r.alias("r")))
    told = F.transform(
        F.filter(labelled, lambda x: x["label"].endswith(" by")),
        lambda x: edge(1, x["pos"], F.replace(x["label"], F.lit(" by"), F.lit(tax.SUFFIX)), F.lit("model"), F.lit(None), x["r"]["quote"], x["r"]["rationale"], F.trim(or_empty(x["r"]["acting_case"]))),
    )
    # Both kinds come out of one pass over the groups.
    each = flagged.withColumn("_first", first).select("citing", "cited", F.col("n").alias("authority_n"), F.coalesce("n_mentions", F.lit(0)).cast("int").alias("n_mentions"), "scope", F.explode(F.concat(F.when(F.col("_first"), F.array(own)).otherwise(F.array()), told)).alias("e"))
    return each.select("citing", "cited", "authority_n", "n_mentions", "scope", "e.*").select(EDGE)


def _side(opinions: DataFrame, courts: DataFrame, side: str) -> DataFrame:
    """Opinions with their court's fields, all named ``<side>_...``."""
    c = court_fn.with_state(courts)
    o = opinions.join(c, "court", "left")
    keep = {"court": "court", "level": "level", "category": "category", "jurisdiction": "jurisdiction", "state": "state", "date_filed": "date_filed", "case_name": "case_name", "display": "court_display", "citations": "citations", "tier": "tier", "is_scoped": "is_scoped", "docket_number": "docket_number", "last_resort": "last_resort"}
    return o.select(F.col("cluster_id").alias(side), *[F.col(k).alias(f"{side}_{v}") for k, v in keep.items() if k in o.columns])


def verdict() -> Column:
    """E2 on joined edges: the first check that fails, or ok."""
    direct, vertical = F.array_contains(array_of(tax.DIRECT), F.col("treatment")), F.array_contains(array_of(tax.VERTICAL), F.col("treatment"))
    return (
        F.when(F.col("citing_court").isNull() | F.col("cited_court").isNull(), "unknown_cluster")
        .when(F.col("citing_level").isNull() | F.col("cited_level").isNull(), "unknown_level")
        .when((F.col("citing") != F.col("cited")) & (F.col("citing_date_filed") <= F.col("cited_date_filed")), "temporal")
        .when(direct & (F.col("citing_level") >= F.col("cited_level")), "hierarchy")
        .when(vertical & (F.col("citing_level") > F.col("cited_level")), "hierarchy")
        .otherwise("ok")
    )


def joined(edges: DataFrame, opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """Edges with both opinions' fields, the verdict and the relation.

    The court dimension is small and Spark broadcasts it by its size; the joins with
    opinions shuffle by citing and then by cited id, and skewed ids are split."""
    out = edges.join(_side(opinions, courts, "citing"), "citing", "left").join(_side(opinions, courts, "cited"), "cited", "left")
    return out.withColumns({"verdict": verdict(), "relation": court_fn.relation("cited_", "citing_"), "severity": tax.severity(F.col("treatment")), "direction": tax.direction(F.col("treatment"))})


def valid(views: DataFrame) -> DataFrame:
    """All but edges that the dates rule out, onto opinions in scope."""
    return views.filter((F.col("verdict") != "temporal") & F.col("cited_is_scoped"))


def tallies(views: DataFrame) -> DataFrame:
    """Edges by verdict."""
    return views.groupBy("verdict").agg(F.count("*").alias("n"))


def direct_history(edges: DataFrame) -> DataFrame:
    """E5: (actor, target, links, first_ord): direct acts of each pair, most serious first."""
    link = F.struct(tax.rank(tax.severity(F.col("treatment"))).alias("rank"), "edge_ord", "treatment", tax.severity(F.col("treatment")).alias("severity"), or_empty(F.col("quote")).alias("quote"))
    pairs = edges.filter(F.array_contains(array_of(tax.DIRECT), F.col("treatment"))).groupBy(F.col("citing").alias("actor"), F.col("cited").alias("target"))
    return pairs.agg(F.transform(F.array_sort(F.collect_list(link)), lambda x: F.struct(x["treatment"].alias("treatment"), x["severity"].alias("severity"), x["quote"].alias("quote"))).alias("links"), F.min("edge_ord").alias("first_ord"))


def reported_acts(views: DataFrame) -> DataFrame:
    """Direct acts that later opinions only report, from valid edges."""
    return valid(views).filter(tax.is_recognized(F.col("treatment")) & tax.is_direct(F.col("treatment")))
