"""Entity resolution of citation groups to opinions of the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriscope.functions.text import cite_key, clean_authority_name, filled, is_case_group, or_empty, other_forms, short_name

_NONE = "array<string>"


def _list(c: str) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def cite_owners(opinions: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(key, owner): the opinion first in load order that has a citation, its own
    citations or those that the metadata gives it."""
    cites = opinions.select("cluster_id", "load_ord", F.explode(_list("citations")).alias("cite"))
    if metadata is not None:
        more = metadata.select("cluster_id", F.explode(_list("citations")).alias("cite")).join(opinions.select("cluster_id", "load_ord"), "cluster_id")
        cites = cites.unionByName(more)
    return cites.groupBy(cite_key(F.col("cite")).alias("key")).agg(F.min_by("cluster_id", "load_ord").alias("owner"))


def name_owners(opinions: DataFrame) -> DataFrame:
    """(name, owner) of first-party names that one opinion alone has."""
    named = opinions.select("cluster_id", short_name(F.col("case_name")).alias("name")).filter(F.length("name") >= 5)
    return named.groupBy("name").agg(F.min("cluster_id").alias("owner"), F.max("cluster_id").alias("_last")).filter("owner = _last").drop("_last")


def resolve(groups: DataFrame, opinions: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``groups`` with resolved, by the attached id, else by the first citation
    that an opinion owns, else by an unambiguous first party; three joins, no UDF."""
    forms = groups.select("cluster_id", "n", F.posexplode(F.concat(_list("citations"), _list("cited_as"))).alias("pos", "form"))
    hits = forms.withColumn("key", cite_key(F.col("form"))).join(cite_owners(opinions, metadata), "key")
    by_cite = hits.groupBy("cluster_id", "n").agg(F.min_by("owner", "pos").alias("by_cite"))
    named = groups.withColumn("_name", short_name(F.coalesce(filled(F.col("name")), filled(F.col("cl_name")), F.lit(""))))
    found = named.join(by_cite, ["cluster_id", "n"], "left").join(name_owners(opinions).withColumnsRenamed({"name": "_name", "owner": "by_name"}), "_name", "left")
    attached = F.when(F.coalesce("cited_cluster_id", F.lit(0)) != 0, F.col("cited_cluster_id"))
    return found.withColumn("resolved", F.coalesce(attached, "by_cite", "by_name")).drop("_name", "by_cite", "by_name")


def resolve_groups(groups: DataFrame, opinions: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Takes a resolved id over only where the collection holds that opinion."""
    known = opinions.select(F.col("cluster_id").alias("resolved"), F.lit(True).alias("_known")).distinct()
    out = resolve(groups, opinions, metadata).join(known, "resolved", "left")
    return out.withColumn("cited_cluster_id", F.when(F.col("_known"), F.col("resolved")).otherwise(F.col("cited_cluster_id"))).drop("resolved", "_known")


def enrich(groups: DataFrame, cite_map: DataFrame, metadata: DataFrame, treatments: DataFrame) -> DataFrame:
    """J1 to J4, P1, P5, P6: citation groups that refer to cases, with the id that
    the opinion's own links give, the cited case's metadata and the treatment.

    ``cite_map``: cluster_id, cite, target, case_name, ord (H5); ``treatments``:
    cluster_id, n, applied, severity, other_label, quote, rationale, recognized, gold."""
    g = groups.filter(is_case_group(F.col("name"), F.col("cl_name"), F.col("cited_as"), F.col("citations")))
    tries = g.filter(F.coalesce("cited_cluster_id", F.lit(0)) == 0).select("cluster_id", "n", F.posexplode(_list("citations")).alias("pos", "form"))
    tries = tries.select("cluster_id", "n", F.explode(F.array(F.struct((2 * F.col("pos")).alias("at"), F.col("form").alias("cite")), F.struct((2 * F.col("pos") + 1).alias("at"), F.trim(F.substring_index("form", ",", 1)).alias("cite")))).alias("t"))
    links = cite_map.groupBy("cluster_id", "cite").agg(F.min_by(F.struct("target", "case_name"), "ord").alias("hit"))
    hit = tries.select("cluster_id", "n", "t.at", "t.cite").join(links, ["cluster_id", "cite"]).groupBy("cluster_id", "n").agg(F.min_by("hit", "at").alias("hit"))
    g = g.join(hit, ["cluster_id", "n"], "left")
    g = g.withColumns({"cited_cluster_id": F.coalesce(F.when(F.coalesce("cited_cluster_id", F.lit(0)) != 0, F.col("cited_cluster_id")), F.col("hit.target")), "cl_name": F.coalesce(filled(F.col("cl_name")), F.col("hit.case_name"))}).drop("hit")
    m = metadata.select(F.col("cluster_id").alias("cited_cluster_id"), F.struct("case_name", "date_filed", "court_id", "court_name", "citations").alias("m"))
    g = g.join(m, "cited_cluster_id", "left").join(treatments, ["cluster_id", "n"], "left")
    name = clean_authority_name(F.coalesce(filled(F.col("name")), filled(F.col("m.case_name")), filled(F.col("cl_name")), F.get(_list("citations"), F.lit(0)), F.lit("")))
    return g.withColumns({"name": name}).withColumns({"cited_as": other_forms(F.col("cited_as"), F.col("citations"), F.col("name")), "court": or_empty(F.col("m.court_id")), "date_filed_iso": or_empty(F.col("m.date_filed"))}).drop("m")
