"""The JSON corpus: folders of payloads, citation groups, treatments and metadata.

Schemas are declared, never inferred: maps keyed by numbers would become structs of
thousands of fields.  Readers go through Spark alone, so any file system will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juriscope.functions import courts as court_fn
from juriscope.functions import documents, text
from juriscope.functions import taxonomy as tax
from juriscope.operators import edges, resolve

WRITING = "struct<id:string,type:string,author:string,html:string>"
PAYLOAD = f"cluster_id bigint, case_name string, docket_number string, citations array<string>, court string, court_full_name string, court_short_name string, court_jurisdiction string, date_filed string, opinions array<{WRITING}>"
CENTRALIA = f"used boolean, opinions array<{WRITING}>"
GROUPS = f"opinions array<{WRITING}>, groups array<struct<gid:string,n:int,name:string,cl_name:string,cited_cluster_id:bigint,citations:array<string>,cited_as:array<string>,n_mentions:int>>, occurrences map<string,string>, manual array<struct<op_id:string,text:string,nth:int,group:string>>"
RECOGNIZED = "struct<treatment:string,severity:string,quote:string,rationale:string,acting_case:string>"
TREATMENTS = f"treatments map<string,struct<applied:string,severity:string,direction:string,other_label:string,quote:string,rationale:string,recognized:array<{RECOGNIZED}>>>, gold map<string,struct<final:string>>, disposition struct<label:string,text:string>, on_appeal array<struct<court:string,name:string,quote:string>>"
METADATA = "map<string,struct<case_name:string,date_filed:string,status:string,court_id:string,court_name:string,citations:array<string>>>"
COUNTS = "struct<per_authority:map<string,struct<total:bigint,controlling:bigint>>>"
# Payload folders in load order and the tier of each.
FOLDERS = [("anchor_opinions", "anchor"), ("authorities", "authority"), ("citing_opinions", "citing"), ("citing_opinions_round2", "citing")]


@dataclass
class Corpus:
    """What a source returns; the counterpart of a catalog."""

    opinions: DataFrame
    groups: DataFrame
    edges: DataFrame
    courts: DataFrame
    counts: DataFrame


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: one JSON object a file, with the file's stem; no rows where nothing is there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("stem", F.lit(""))
    rows = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json")
    return rows.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def read_object(spark: SparkSession, path: str, kind: str, column: str) -> DataFrame:
    """S3: a file that is one JSON value; no rows where it is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string").select(F.from_json("value", kind).alias(column))
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias(column))


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """S2, SO1: all folders; a stem in several folders keeps the first one's row. Load
    order is the folder, then the stem as a number."""
    if not exists(spark, f"{root}/{FOLDERS[0][0]}"):
        raise FileNotFoundError(f"{root}/{FOLDERS[0][0]}")
    parts = [read_folder(spark, f"{root}/{name}", PAYLOAD).withColumns({"tier": F.lit(tier), "folder": F.lit(i)}) for i, (name, tier) in enumerate(FOLDERS)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    first = F.row_number().over(Window.partitionBy("stem").orderBy("folder"))
    rows = rows.withColumn("_first", first).filter("_first = 1").drop("_first")
    return rows.withColumn("load_ord", F.col("folder") * F.lit(1 << 48) + F.col("stem").cast("bigint"))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of cited cases by cluster."""
    m = read_object(spark, f"{root}/cited_metadata.json", METADATA, "m").select(F.explode("m").alias("key", "v"))
    return m.select(F.col("key").cast("bigint").alias("cluster_id"), "v.*")


def citing_counts(spark: SparkSession, root: str) -> DataFrame:
    """Citing counts; the later file overrides."""
    parts = [read_object(spark, f"{root}/{name}", COUNTS, "c").select(F.explode("c.per_authority").alias("key", "v")).withColumn("file", F.lit(i)) for i, name in enumerate(("citing_counts_authorities.json", "citing_counts_citing.json"))]
    both = parts[0].unionByName(parts[1])
    return both.groupBy(F.col("key").cast("bigint").alias("cluster_id")).agg(F.max_by("v", "file").alias("v")).select("cluster_id", "v.total", "v.controlling")


def citing_scope(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the citing scope."""
    schema = "citing_cluster_id bigint, anchor_opinion_id bigint, anchor_cluster_id bigint"
    out = spark.createDataFrame([], schema)
    for name in ("citing_edges.csv", "citing_edges_round2.csv"):
        if exists(spark, f"{root}/{name}"):
            rows = spark.read.csv(f"{root}/{name}", header=True)
            wide = rows.select(*[(F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None)).cast("bigint").alias(c) for c in ("citing_cluster_id", "anchor_opinion_id", "anchor_cluster_id")])
            out = out.unionByName(wide)
    return out


def load(spark: SparkSession, root: str) -> Corpus:
    """The whole corpus: opinions with documents, groups resolved, edges, courts."""
    p = payloads(spark, root)
    c = read_folder(spark, f"{root}/centralia", CENTRALIA).filter("used and size(opinions) > 0").select("stem", F.col("opinions").alias("reread"))
    g = read_folder(spark, f"{root}/citation_groups", GROUPS).select("stem", F.col("opinions").alias("seeded"), "groups", "occurrences", "manual")
    t = read_folder(spark, f"{root}/treatments", TREATMENTS)
    rows = p.join(c, "stem", "left").join(g, "stem", "left").join(t, "stem", "left")
    has = lambda col: F.size(F.coalesce(col, F.array())) > 0
    rows = rows.withColumn("writings", F.when(has("seeded"), F.col("seeded")).when(has("reread"), F.col("reread")).otherwise(F.coalesce("opinions", F.array().cast(f"array<{WRITING}>"))))
    # The writings' citation spans get the numbers of their groups; a text that was read anew
    # gets the citations that the payload's own html links.
    cited = F.transform("groups", lambda x: F.struct(x["gid"].alias("gid"), x["n"].alias("n"), x["cited_cluster_id"].cast("string").alias("cluster"), F.coalesce(text.filled(x["name"]), text.filled(x["cl_name"]), F.lit("")).alias("name")))
    sources = F.array_join(F.transform(F.coalesce("opinions", F.array().cast(f"array<{WRITING}>")), lambda o: text.or_empty(o["html"])), "\n")
    rows = rows.withColumn("document", documents.document_udf("writings", has("seeded"), F.map_entries("occurrences"), cited, "manual", documents.cite_map_udf(sources)))
    cites = text.order_citations(F.coalesce("citations", F.array().cast("array<string>")))
    opinions = rows.select(
        "cluster_id",
        "load_ord",
        "tier",
        text.display_name(F.col("case_name"), cites, F.col("docket_number")).alias("case_name"),
        (F.trim(text.or_empty(F.col("case_name"))) == "").alias("name_missing"),
        text.or_empty(F.col("docket_number")).alias("docket_number"),
        cites.alias("citations"),
        text.or_empty(F.col("court")).alias("court"),
        text.or_empty(F.col("date_filed")).alias("date_filed"),
        F.lit(True).alias("is_scoped"),
        F.filter(F.transform("opinions", lambda o: o["id"].try_cast("bigint")), lambda i: i.isNotNull()).alias("opinion_ids"),
        "document",
        "disposition",
        "on_appeal",
    )
    each = rows.select("cluster_id", "load_ord", F.explode("groups").alias("g"), "treatments", "gold").select("cluster_id", "load_ord", "g.*", F.element_at("treatments", F.col("g.n").cast("string")).alias("t"), F.element_at("gold", F.col("g.n").cast("string"))["final"].alias("expert_treatment"))
    treated = each.select("cluster_id", "n", F.col("t.applied").alias("treatment"), tax.recorded_severity(F.col("t.applied"), F.col("t.severity")).alias("severity"), F.col("t.other_label").alias("treatment_other_label"), "t.quote", "t.rationale", "t.recognized", "expert_treatment", F.lit("model").alias("source"))
    links = rows.select("cluster_id", F.posexplode("opinions").alias("w", "o")).select("cluster_id", "w", F.posexplode(documents.cite_map_udf("o.html")).alias("k", "c"))
    links = links.select("cluster_id", "c.cite", F.col("c.target").cast("bigint").alias("target"), "c.case_name", F.struct("w", "k").alias("ord"))
    meta = metadata(spark, root)
    groups = resolve.enrich(each.drop("t", "expert_treatment"), links, meta, treated)
    groups = resolve.resolve_groups(groups, opinions, meta)
    pairs = edges.scope_pairs(citing_scope(spark, root), opinions)
    return Corpus(opinions, groups, edges.build(groups, opinions, pairs), court_fn.registered(p), citing_counts(spark, root))


def _fixtures(spark: SparkSession, root: str) -> Corpus:
    from juriscope.sources import fixtures

    return fixtures.load(spark, root)


#: Sources by name; each takes (spark, root) and returns a Corpus.
SOURCES = {"json": load, "fixtures": _fixtures}
#: The setting that names a source where the caller doesn't.
SOURCE_CONF = "spark.juriscope.source"


def load_source(name: str | None, spark: SparkSession, root: str) -> Corpus:
    """A source by its name, or by the session's setting, or of JSON files."""
    name = name or spark.conf.get(SOURCE_CONF, "json")
    if name not in SOURCES:
        raise ValueError(f"no source {name}: {', '.join(SOURCES)}")
    return SOURCES[name](spark, root)


def flag(value: str | None) -> bool:
    """K5: whether a build flag is set."""
    return (value or "") not in ("", "0", "false")
