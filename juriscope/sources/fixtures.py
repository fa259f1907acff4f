"""Fixtures made by rule, as a Python data source that Spark reads in partitions.

``spark.read.format("juriscope_fixtures").option("table", t).load()`` reads one of the tables
``opinions``, ``external`` and ``edges``.  Options ``pages``, ``external`` and ``edges`` tell
their sizes and ``partitions`` the number of slices; a row follows from its number alone, so
every slice is read by itself, and anew where an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from juriscope.functions import courts as court_fn
from juriscope.functions import taxonomy as tax
from juriscope.functions import text
from juriscope.functions.documents import string_document
from juriscope.sources.scratch import written

SIZES = {"pages": 10, "external": 39, "edges": 59}
ABOUT = "cluster_id long, case_name string, docket_number string, citations array<string>, court string, date_filed string"
SCHEMAS = {
    "opinions": f"{ABOUT}, document_text string",
    "external": ABOUT,
    "edges": "ord long, citing long, cited long, treatment string, quote string, rationale string, source string, expert_treatment string, acting_case string",
}
#: Courts of the fixtures, by the number of the opinion.
COURTS = ["ord", "ca2", "scotus", "cand", "ca9"]
NAMES = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Ginkgo", "Hazel"]
SUBJECTS = ["the lease", "the warrant", "the patent", "the will", "the ferry contract"]
FIRST_PAGE, FIRST_EXTERNAL = 1001, 900_001


def _about(cluster: int, i: int, year: int) -> tuple:
    a, b = NAMES[i % 8], NAMES[(i // 8 + i + 3) % 8]
    return (cluster, f"{a} v. {b} Mills", f"No. {year % 100:02d}-{100 + i}", [f"{300 + i} U.S. {7 * i + 1}"], COURTS[i % 5], f"{year}-{i % 12 + 1:02d}-{i % 27 + 1:02d}")


def _sentence(i: int) -> str:
    return f"The court weighed {SUBJECTS[i % 5]} of {NAMES[i % 8]} & Sons against the record of the {i + 1} hearings below."


def page(i: int, sizes: dict[str, int]) -> tuple:
    """The i-th opinion with a page: a text of a preamble and one or two sections that cites
    the page before it."""
    about = _about(FIRST_PAGE + i, i, 1980 + i % 20)
    cites = f'See <citedCase data-cluster-id="{FIRST_PAGE + i - 1}" data-case="{NAMES[(i - 1) % 8]}">{299 + i} U.S. {7 * i - 6}</citedCase>.' if i else "No case is on point."
    parts = [f"Argued in term {i + 1} <before the full bench>.", "## Opinion of the Court", f"{_sentence(i)} {cites}", "The judgment stands on that ground and on no other."]
    if i % 3 == 0:
        parts += ["## Dissent", f"I would have read {SUBJECTS[i % 5]} the other way."]
    return (*about, "\n\n".join(parts))


def external(j: int, sizes: dict[str, int]) -> tuple:
    """The j-th opinion that is known by its metadata alone."""
    return _about(FIRST_EXTERNAL + j, j + 1, 2001 + j % 20)


def edge(e: int, sizes: dict[str, int]) -> tuple:
    """The e-th edge: every external opinion cites a page, then pages cite the first one."""
    known = tax.TREATMENTS[e % len(tax.TREATMENTS)][0]
    if e < sizes["external"] or sizes["pages"] < 2:
        citing, cited, quote = FIRST_EXTERNAL + e % max(sizes["external"], 1), FIRST_PAGE + e % max(sizes["pages"], 1), ""
    else:
        i = (e - sizes["external"]) % (sizes["pages"] - 1) + 1
        citing, cited, quote = FIRST_PAGE + i, FIRST_PAGE, _sentence(i)
    reports = e % 7 == 6
    label = known.replace(" by", tax.SUFFIX) if reports else known
    return (e, citing, cited, label, quote, f"Reason {e}.", "expert" if e % 11 == 0 else "model", known if e % 11 == 0 else None, "the United States Supreme Court" if reports else "")


ROWS = {"opinions": (page, "pages"), "external": (external, "external"), "edges": (edge, "edges")}


class Slice(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class FixtureReader(DataSourceReader):
    def __init__(self, table: str, sizes: dict[str, int], slices: int):
        self.table, self.sizes, self.slices = table, sizes, slices

    def partitions(self) -> list[Slice]:
        n = self.sizes[ROWS[self.table][1]]
        cuts = [n * k // self.slices for k in range(self.slices + 1)]
        return [Slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        make = ROWS[self.table][0]
        return (make(i, self.sizes) for i in range(partition.start, partition.stop))


class Fixtures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "juriscope_fixtures"

    def _table(self) -> str:
        table = self.options.get("table", "opinions")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table}: {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> FixtureReader:
        sizes = {k: int(self.options.get(k, v)) for k, v in SIZES.items()}
        slices = int(self.options.get("partitions", 4))
        if slices < 1 or min(sizes.values()) < 0:
            raise ValueError("sizes must not be negative, and there must be a partition")
        return FixtureReader(self._table(), sizes, slices)


def tables(spark: SparkSession, **options) -> dict[str, DataFrame]:
    spark.dataSource.register(Fixtures)
    return {t: spark.read.format("juriscope_fixtures").options(table=t, **options).load() for t in SCHEMAS}


def load(spark: SparkSession, root: str = "", **options):
    """The fixtures as a corpus. There are no citation groups, so no Authorities rows; an
    external opinion takes the place of a page's metadata under the same id."""
    from juriscope.sources.json_corpus import Corpus

    # Written once: a page's plan reads opinions and edges many times over.
    t = {name: written(rows, name) for name, rows in tables(spark, **options).items()}
    pages, far = t["opinions"], t["external"].withColumn("document_text", F.lit(None).cast("string"))
    both = pages.join(far.select("cluster_id"), "cluster_id", "left_anti").withColumn("is_scoped", F.lit(True)).unionByName(far.withColumn("is_scoped", F.lit(False)))
    cites = text.order_citations(F.col("citations"))
    opinions = both.select(
        "cluster_id",
        F.col("cluster_id").alias("load_ord"),
        F.when(F.col("is_scoped"), "anchor").otherwise("citing").alias("tier"),
        text.display_name(F.col("case_name"), cites, F.col("docket_number")).alias("case_name"),
        (F.trim(text.or_empty(F.col("case_name"))) == "").alias("name_missing"),
        text.or_empty(F.col("docket_number")).alias("docket_number"),
        cites.alias("citations"),
        text.or_empty(F.col("court")).alias("court"),
        text.or_empty(F.col("date_filed")).alias("date_filed"),
        "is_scoped",
        F.array().cast("array<bigint>").alias("opinion_ids"),
        F.when(F.col("is_scoped"), string_document(F.col("document_text"))).alias("document"),
        F.lit(True).alias("is_text"),
        F.lit(None).cast("struct<label:string,text:string>").alias("disposition"),
        F.lit(None).cast("array<struct<court:string,name:string,quote:string>>").alias("on_appeal"),
    )
    e = t["edges"]
    ord_ = F.struct(F.col("ord").alias("load_ord"), F.lit(1).alias("n"), F.lit(0).alias("kind"), F.lit(0).alias("pos"))
    edges = e.select(ord_.alias("edge_ord"), "citing", "cited", "treatment", "source", "expert_treatment", "quote", "rationale", "acting_case", F.lit(None).cast("int").alias("authority_n"), F.lit(0).alias("n_mentions"), F.lit("collection").alias("scope"))
    recognized = "array<struct<treatment:string,severity:string,quote:string,rationale:string,acting_case:string>>"
    groups = spark.createDataFrame([], f"cluster_id long, n int, cited_cluster_id long, name string, cited_as array<string>, citations array<string>, court string, treatment string, severity string, quote string, rationale string, treatment_other_label string, expert_treatment string, n_mentions int, date_filed_iso string, recognized {recognized}")
    named = both.select("court", F.lit(None).cast("string").alias("court_full_name"), F.lit(None).cast("string").alias("court_short_name"), F.lit("F").alias("court_jurisdiction"), F.col("cluster_id").alias("load_ord"))
    counts = spark.createDataFrame([], "cluster_id long, total long, controlling long")
    return Corpus(opinions, groups, edges, court_fn.registered(named), counts)
