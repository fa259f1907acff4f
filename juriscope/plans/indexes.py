"""C4: the graph's indexes, each derived once from an input and read by every query.

An index is a table in the shared folder, cut into buckets and sorted within them, so that
a plan that groups or joins by its keys reads it without an exchange:

- ``views``, edges with the fields of both opinions, by the pair (cited, citing): the rows of
  an opinion that a third of all others cite lie in all buckets;
- ``down`` and ``up``, the direct history from the acting and from the reviewed opinion;
- ``sides``, opinions with their court, by id;
- ``groups``, resolved citation groups, and ``authorities``, by the opinion that cites;
- ``later``, one row for each (cited, citing) pair, from ``views``.

Plans over all edges read ``judged`` and ``recorded``, numbered edges that are not written:
``views`` with all its fields is many times as large as the input.

An index belongs to the session and to the input's files, their sizes and times; other files
make other indexes.  The number of buckets follows the input's size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juriscope.operators import authorities, condense, edges, history, hubs, later_courts, resolve
from juriscope.sources import testdata as data
from juriscope.sources.scratch import scratch_path, written

#: Bytes of input for each bucket, at most.
BUCKET_BYTES = 64 << 20
TABLES = ("lineitem", "orders", "customer", "nation", "region")


def bucketed(df: DataFrame, tag: str, by: list[str], n: int, sort: list[str] | None = None) -> DataFrame:
    """``df`` as a table of n buckets by ``by``, each one sorted file."""
    name = f"juriscope_{tag}_{uuid.uuid4().hex[:12]}"
    files = df.repartition(n, *by).sortWithinPartitions(*(sort or by))
    files.write.format("parquet").bucketBy(n, *by).sortBy(*(sort or by)).option("path", scratch_path(df.sparkSession, tag)).saveAsTable(name)
    return df.sparkSession.table(name)


class Graph:
    """The indexes of one input; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, size: int):
        self.spark, self.sf_dir, self.built = spark, sf_dir, {}
        self.n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def index(self, tag: str, make: Callable[[], DataFrame], by: list[str], sort: list[str] | None = None) -> DataFrame:
        if tag not in self.built:
            self.built[tag] = bucketed(make(), tag, by, self.n, sort)
        return self.built[tag]

    @property
    def courts(self) -> DataFrame:
        return data.courts(self.spark, self.sf_dir)

    @property
    def opinions(self) -> DataFrame:
        return self.index("opinions", lambda: data.opinions(self.spark, self.sf_dir), ["cluster_id"])

    @property
    def views(self) -> DataFrame:
        return self.index("views", lambda: edges.joined(data.edges(self.spark, self.sf_dir), self.opinions, self.courts), ["cited", "citing"])

    @property
    def unique(self) -> bool:
        """Whether every id names one opinion, in one court: then an edge is one row of ``views``."""
        if "unique" not in self.built:
            twice = lambda df, c: not df.groupBy(c).agg(F.count("*").alias("n")).filter(f"n > 1 AND {c} IS NOT NULL").isEmpty()
            self.built["unique"] = not (twice(self.courts, "court") or twice(data.sides(self.spark, self.sf_dir), "id"))
        return self.built["unique"]

    @property
    def recorded(self) -> DataFrame:
        """Marks as they are recorded: no join where opinions can't make two rows of an edge."""
        return data.told(data.marks(self.spark, self.sf_dir)) if self.unique else self.judged

    @property
    def judged(self) -> DataFrame:
        """Marks with their verdict, dealt out by the cited opinion; by the pair where an
        opinion has more rows than a task should hold. It is read where it is used: written,
        it would be as large as the input."""
        return self.dealt(data.judged(data.marks(self.spark, self.sf_dir), data.sides(self.spark, self.sf_dir), self.courts))

    def dealt(self, judged: DataFrame) -> DataFrame:
        if "hubs" not in self.built:
            self.built["hubs"] = not hubs.hubs(data.marks(self.spark, self.sf_dir), "cited").isEmpty()
        return judged.repartition(self.n, "cited", "citing") if self.built["hubs"] else judged

    def acts(self, of: DataFrame | None = None) -> DataFrame:
        """The acts of the pairs that ``later`` has a row for; with ``of`` (cited) on its opinions only."""
        kept = data.valid(self.judged)
        return data.acts(kept if of is None else kept.join(of, "cited", "left_semi"))

    @property
    def sort_keys(self) -> DataFrame:
        """What the rows of ``later`` are sorted by."""
        if "sort_keys" not in self.built:
            sides = data.sides(self.spark, self.sf_dir, named=True)
            self.built["sort_keys"] = written(data.sort_keys(data.valid(self.dealt(data.judged(data.marks(self.spark, self.sf_dir), sides, self.courts)))), "sort_keys")
        return self.built["sort_keys"]

    @property
    def later(self) -> DataFrame:
        return self.index("later", lambda: later_courts.rows(edges.valid(self.views)), ["cited", "citing"])

    @property
    def judged_acts(self) -> DataFrame:
        """Direct acts that edges record (without fault) and that they report (validly): judged once for both."""
        if "judged_acts" not in self.built:
            fit = self.judged.filter("direct AND (recognized AND verdict <> 'temporal' AND cited_is_scoped OR NOT recognized AND verdict = 'ok')")
            self.built["judged_acts"] = written(fit.select("citing", "cited", "line", "supp", "quantity", "recognized", "citing_date_filed"), "judged_acts")
        return data.told(self.built["judged_acts"])

    @property
    def direct(self) -> DataFrame:
        """Direct acts among valid edges: each leads to a strictly lower court, so chains end."""
        return self.index("direct", lambda: edges.direct_history(data.worded(self.judged_acts.filter("NOT recognized"))), ["actor", "target"])

    @property
    def raw_direct(self) -> DataFrame:
        """(actor, target, n_links, worst): direct acts as recorded: dates and courts rule
        none out, so there are cycles."""

        def make() -> DataFrame:
            acts = self.recorded.filter("direct AND NOT recognized").select(F.col("citing").alias("actor"), F.col("cited").alias("target"), F.struct("rank", "line", "supp", "label").alias("act"))
            return acts.groupBy("actor", "target").agg(F.count("*").cast("int").alias("n_links"), F.min("act")["label"].alias("worst"))

        return self.index("raw_direct", make, ["actor", "target"])

    @property
    def down(self) -> DataFrame:
        return self.index("down", lambda: self.direct.select("actor", "target"), ["actor"], ["actor", "target"])

    @property
    def up(self) -> DataFrame:
        return self.index("up", lambda: self.direct.select("actor", "target"), ["target"], ["target", "actor"])

    @property
    def chains(self) -> DataFrame:
        """The chain of every opinion over valid edges."""
        return self.index("chains", lambda: history.reach_of_all(self.down), ["cluster_id"], ["cluster_id", "node"])

    @property
    def whole_chains(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and drawn reports of every chain; a chain may be its seed alone."""
        if "whole_chains" not in self.built:
            o = data.opinions(self.spark, self.sf_dir)
            m = history.members(self.chains, o.select("cluster_id"), o, self.courts)
            # What they are put together from is written; as tables of their own they would be so twice.
            self.built["whole_chains"] = history.whole_chain(m, self.direct, data.records(self.spark, self.sf_dir), self.reported)
        return self.built["whole_chains"]

    @property
    def places(self) -> DataFrame:
        """(cluster_id, node, date_filed, at): the opinions of every chain, numbered, without their fields."""
        if "places" not in self.built:
            o = data.opinions(self.spark, self.sf_dir).select("cluster_id", "date_filed")
            nodes = o.select("cluster_id", F.col("cluster_id").alias("node"), "date_filed", F.lit("self").alias("role"))
            nodes = nodes.unionByName(self.chains.join(o.withColumnRenamed("cluster_id", "node"), "node").select("cluster_id", "node", "date_filed", "role"))
            self.built["places"] = written(history.placed_members(nodes).drop("role"), "places")
        return self.built["places"]

    @property
    def events(self) -> DataFrame:
        """What is reported on every chain and not recorded in it, in the order of drawing."""
        if "events" not in self.built:
            side = lambda name: self.places.select("cluster_id", F.col("node").alias(name), F.col("at").alias(f"{name}_at"))
            known = self.direct.select("actor", "target", "links").join(side("actor"), "actor").join(side("target"), ["cluster_id", "target"]).select("cluster_id", F.col("target_at").alias("target"), "links")
            self.built["events"] = written(history.report_events(self.reported, self.places, known), "events")
        return self.built["events"]

    @property
    def components(self) -> DataFrame:
        """(node, component) of the opinions that are in a cycle of direct acts as recorded."""
        return self.index("components", lambda: condense.components(self.raw_direct), ["node"])

    @property
    def condensation(self) -> DataFrame:
        """(upper, lower): direct acts as recorded between components, without cycles."""
        return self.index("condensation", lambda: condense.condensed(self.raw_direct, self.components), ["upper"], ["upper", "lower"])

    @property
    def raw_reach(self) -> DataFrame:
        """(upper, lower): what each component reaches."""
        if "raw_reach" not in self.built:
            self.built["raw_reach"] = written(condense.closure(self.condensation), "raw_reach")
        return self.built["raw_reach"]

    @property
    def groups(self) -> DataFrame:
        return self.index("groups", lambda: resolve.resolve_groups(data.groups(self.spark, self.sf_dir), self.opinions), ["cluster_id"])

    @property
    def authorities(self) -> DataFrame:
        def make() -> DataFrame:
            n = F.row_number().over(authorities.Window.partitionBy("cluster_id").orderBy("n"))
            g = self.groups.withColumn("n", n).withColumns({"court": F.lit(""), "treatment_other_label": F.lit("")})
            return authorities.rows(g, self.opinions, self.courts)

        return self.index("authorities", make, ["cluster_id"])

    @property
    def reported(self) -> DataFrame:
        """Direct acts that later opinions only report, with the names of those opinions."""
        acts = data.worded(self.judged_acts.filter("recognized")).withColumn("target", F.col("cited"))
        names = data.opinions(self.spark, self.sf_dir).select(F.col("cluster_id").alias("citing"), F.col("case_name").alias("citing_case_name"))
        acts = acts.select("target", "citing", "treatment", "severity", "edge_ord", "acting_case", F.col("citing_date").alias("citing_date_filed"))
        return acts.join(names, "citing", "left")

    @property
    def reports(self) -> DataFrame:
        """Reported acts that no recorded act on their target covers."""
        if "reports" not in self.built:
            found = history.unrecorded_reports(self.reported.select("target", "citing", "treatment"), self.direct)
            self.built["reports"] = written(found, "reports")
        return self.built["reports"]


_GRAPHS: dict[tuple, Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The indexes of the tables in ``sf_dir`` as they are now."""
    stamp, size = [], 0
    for name in TABLES:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        about, length = fs.getFileStatus(at), fs.getContentSummary(at).getLength()
        stamp.append((name, length, about.getModificationTime()))
        size += length
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, *stamp)
    if key not in _GRAPHS:
        _GRAPHS[key] = Graph(spark, sf_dir, size)
    return _GRAPHS[key]
