"""The registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juriscope.functions import courts as court_fn
from juriscope.functions import taxonomy as tax
from juriscope.functions import documents, quotes, sql, text
from juriscope.operators import authorities, citations, condense, edges, history, later_courts, quotations, resolve, search
from juriscope.plans.indexes import graph
from juriscope.sources import testdata as data
from juriscope.sources.scratch import written


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return later_courts.statuses_of(g.acts(), data.opinions(spark, sf_dir), g.courts)


def _index(spark: SparkSession, sf_dir: str, p: search.SearchParams | None = None) -> DataFrame:
    """The home page's rows; with ``p`` only those that its text, courts and tier let
    through, and only their edges are joined and grouped."""
    g = graph(spark, sf_dir)
    o = data.opinions(spark, sf_dir).filter("is_scoped").withColumns({"name_missing": F.col("raw_name") == "", "search_text": text.search_text(F.col("case_name"), F.col("citations"))})
    if p:
        o = o.filter(search.told_apart(p))
    acts = g.acts(o.select(F.col("cluster_id").alias("cited")) if p else None)
    s = later_courts.statuses_of(acts, o, g.courts).select("cluster_id", "dh_severity", "cr_severity")
    return o.join(s, "cluster_id")


def later_courts_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What later courts do to every opinion."""
    s = _statuses(spark, sf_dir)
    return s.select("cluster_id", "scope", "on_appeal_state", "on_appeal_treatment", "on_appeal_severity", "later_state", "later_treatment", "later_severity", "later_citing", "n_other_negative", "n_plain", "n_total")


def status_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage that each status row links to."""
    s = _statuses(spark, sf_dir)
    of = lambda side: [F.col(f"{side}_{c}") for c in ("citing", "quote", "authority_n")]
    link = lambda side: F.when(F.col(f"{side}_citing").isNotNull(), text.page_link(F.col(f"{side}_citing"), F.col(f"{side}_authority_n"), F.col(f"{side}_quote"), F.col(f"{side}_quote_status"))).alias(f"{side}_href")
    return s.select("cluster_id", *of("on_appeal"), link("on_appeal"), *of("later"), link("later"))


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tiers that the home page filters by."""
    return _statuses(spark, sf_dir).select("cluster_id", "dh_severity", "cr_severity")


def later_courts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each citing opinion."""
    r = graph(spark, sf_dir).later
    return r.select("cited", "citing", "case_name", "court_display", "date_filed", "date_short", "relation", "treatment", "severity", "recognized_filter", F.size("applied").alias("n_applied"), F.size("recognized").alias("n_recognized"), "n_mentions", "has_detail")


def later_courts_pills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pills of every row in order."""
    kept = data.valid(graph(spark, sf_dir).judged)
    place = F.row_number().over(history.Window.partitionBy("cited", "citing").orderBy("recognized", "rank", "line", "supp", "quantity"))
    return kept.select("cited", "citing", (place - 1).alias("pos"), "treatment", "severity", tax.direction(F.col("treatment")).alias("direction"))


def later_courts_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under every sort key."""
    return later_courts.ranks_of(graph(spark, sf_dir).sort_keys).select("cited", "citing", "dom_index", "severity_index", "recency_index", "name_index", "mentions_index", "court_index")


def later_courts_ranks_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places where every opinion that over 32 others cite is a hub,
    placed in ranges that no single task holds."""
    return later_courts.ranks_of(graph(spark, sf_dir).sort_keys, most=32).select("cited", "citing", "dom_index", "severity_index", "recency_index", "name_index", "mentions_index", "court_index")


def list_sort_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative rows of each list by court, three of each."""
    r = later_courts.ranks(graph(spark, sf_dir).later).withColumn("applied_filter", later_courts.unnamed_filter(F.coalesce(F.get("applied", F.lit(0))["severity"], F.col("severity"))))
    r = r.withColumn("recognized_filter", F.lower("recognized_filter"))
    r = r.filter(search.list_visible("customer", applied=("stop", "warning"), recognized=("stop",)))
    return r.select("cited", "citing", F.col(search.sort_column("later", "court")).alias("ord"))


def pill_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pills and rows that agree or disagree with the expert."""
    kept = data.valid(graph(spark, sf_dir).judged)
    pill = F.struct("rank", "recognized", "line", "supp", "quantity", "label")
    pairs = kept.groupBy("cited", "citing").agg(F.array_sort(F.collect_list(pill)).alias("pills"), F.min_by(data.expert(), F.struct("recognized", "rank", "line", "supp", "quantity")).alias("expert"))
    # States follow from the labels alone: rows of the same labels are told once.
    alike = pairs.groupBy(F.transform("pills", lambda p: F.struct(p["recognized"].alias("recognized"), p["label"].alias("label"))).alias("pills"), "expert").agg(F.count("*").alias("n"))
    alike = alike.withColumn("pills", F.transform("pills", lambda p: F.struct(F.when(p["recognized"], "recognized").otherwise("applied").alias("kind"), p["label"].alias("treatment"), tax.severity(p["label"]).alias("severity"))))
    alike = alike.withColumn("states", tax.pill_states(F.col("pills"), F.col("expert")))
    each = alike.select("n", tax.row_state(F.col("states")).alias("row_state"), F.explode(F.arrays_zip("pills", "states")).alias("p"))
    return each.groupBy("row_state", F.col("p.pills.kind").alias("kind"), F.col("p.states").alias("state")).agg(F.sum("n").cast("long").alias("n"))


def edge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by verdict and tier."""
    return graph(spark, sf_dir).judged.groupBy("verdict", "severity").agg(F.count("*").alias("n"))


def court_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of courts; the dimension is small by nature."""
    c = court_fn.with_state(data.courts(spark, sf_dir))
    side = lambda p: c.select(*[F.col(x).alias(p + x) for x in ("court", "level", "category", "jurisdiction", "state")], F.lit(1).alias("_one"))
    return side("cited_").join(side("citing_"), "_one").select("cited_court", "citing_court", "cited_state", court_fn.relation("cited_", "citing_").alias("relation"))


def court_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6."""
    return court_fn.court_list(data.courts(spark, sf_dir))


def court_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7, W7, A14, SO4."""
    return court_fn.court_picker(data.courts(spark, sf_dir)).select("tab", "n_courts", "group_ord", "group_name", "court_ord", "key", "depth")


def edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, A10, P4, J11, SO2: edges from resolved citation groups, counted by label."""
    o, g = graph(spark, sf_dir).opinions, graph(spark, sf_dir).groups
    scope = g.filter("cluster_id % 2 = 0").select(F.col("cluster_id").alias("citing_cluster_id"), F.lit(None).cast("bigint").alias("anchor_opinion_id"), F.col("cited_cluster_id").alias("anchor_cluster_id"))
    pairs = edges.scope_pairs(scope, o.withColumn("opinion_ids", F.array().cast("array<bigint>")))
    e = edges.build(g, o, pairs)
    return e.groupBy("treatment", "scope").agg(F.count("*").alias("n"), F.sum("n_mentions").cast("long").alias("mentions"), F.countDistinct("citing", "cited").alias("pairs"))


def resolve_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every citation group resolves to."""
    g = graph(spark, sf_dir).groups
    return g.groupBy("cluster_id").agg(F.count("*").alias("n_groups"), F.count("cited_cluster_id").alias("n_resolved"), F.sum("cited_cluster_id").cast("long").alias("sum_ids"))


def cite_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opinion that owns each citation."""
    return resolve.cite_owners(data.opinions(spark, sf_dir))


def name_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one opinion alone has."""
    return resolve.name_owners(data.opinions(spark, sf_dir))


def authority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities by what their opinion does to them."""
    a = graph(spark, sf_dir).authorities
    return a.groupBy("treatment_active", "court_relation", "overall_severity", "recognized_filter", "validation", "is_scoped").agg(F.count("*").alias("n"), F.sum(F.size("evidence_cards")).cast("long").alias("n_cards"), F.count_if("has_detail").alias("n_detail"))


def authority_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, O3."""
    return authorities.ranks(graph(spark, sf_dir).authorities).select("cluster_id", "n", "dom_index", "severity_index", "date_index", "name_index", "mentions_index", "court_index")


def authority_ranks_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places where every opinion of more than four authorities is a hub."""
    return authorities.ranks(graph(spark, sf_dir).authorities, most=4).select("cluster_id", "n", "dom_index", "severity_index", "date_index", "name_index", "mentions_index", "court_index")


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every opinion with its citations tied to its Authorities rows."""
    g = graph(spark, sf_dir)
    n = F.row_number().over(authorities.Window.partitionBy("cluster_id").orderBy("n"))
    texts = data.documents(g.groups.withColumn("n", n)).join(g.opinions.select("cluster_id", "is_scoped"), "cluster_id", "right")
    return citations.bodies(texts, g.authorities)


def authority_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return authorities.meta(data.groups(spark, sf_dir)).select("cluster_id", "n_authorities", F.col("n_mentions").cast("long").alias("n_mentions"))


def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return search.scope_counts(data.opinions(spark, sf_dir), data.courts(spark, sf_dir).count())


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of the home page."""
    o = data.opinions(spark, sf_dir)
    return o.select(
        "cluster_id",
        text.display_name(F.col("raw_name"), F.col("citations"), F.col("docket_number")).alias("case_name"),
        text.search_text(F.col("case_name"), F.col("citations")).alias("search_text"),
        F.array_join(text.docket_numbers(F.col("docket_number")), "|").alias("dockets"),
        text.short_date(F.col("date_filed")).alias("date_short"),
        F.array_join(text.order_citations(F.col("citations")), "|").alias("cites"),
        F.concat(F.lit("/opinion/"), F.col("cluster_id").cast("string"), F.lit("/")).alias("url"),
    )


HOME = search.SearchParams(q="custoMER#00000", dh_sev=("stop", "warning"), cr_sev=("stop",), anchors_only=True)


def home_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a search."""
    return search.search(_index(spark, sf_dir, HOME), HOME).select("page_index", "cluster_id", "case_name", "date_filed", "dh_severity", "cr_severity")


def home_search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of all anchors."""
    p = search.SearchParams(page=1)
    return search.search(_index(spark, sf_dir, p), p).select("page_index", "cluster_id", "case_name")


def home_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, T17."""
    return search.counts(_index(spark, sf_dir), HOME)


def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 as a column: places that a range-partitioned sort gives without one task for all."""
    o = data.opinions(spark, sf_dir).withColumn("name_missing", F.col("raw_name") == "")
    # Places within a date, plus what earlier dates hold: windows over dates, never over everything.
    within = o.withColumn("in_day", F.row_number().over(search.Window.partitionBy("name_missing", "date_filed").orderBy(F.lower("case_name"), "load_ord")))
    days = o.groupBy("name_missing", "date_filed").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.sum("n").over(search.Window.partitionBy("name_missing").orderBy(F.desc("date_filed")).rowsBetween(search.Window.unboundedPreceding, -1)))
    named = days.filter("not name_missing").agg(F.sum("n").alias("n_named"))
    return within.join(before.drop("n"), ["name_missing", "date_filed"]).crossJoin(named).select("cluster_id", (F.col("in_day") - 1 + F.coalesce("before", F.lit(0)) + F.when(F.col("name_missing"), F.col("n_named")).otherwise(0)).cast("long").alias("ord"))


def opinion_index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3: scoped and external opinions as one index; external rows override."""
    o = data.opinions(spark, sf_dir)
    own = o.filter("is_scoped").select("cluster_id", "case_name", F.lit(0).alias("side"))
    far = o.filter("not is_scoped or cluster_id % 50 = 0").select("cluster_id", F.concat(F.lit("external "), "case_name").alias("case_name"), F.lit(1).alias("side"))
    return own.unionByName(far).groupBy("cluster_id").agg(F.max_by("case_name", "side").alias("case_name"), F.max("side").alias("side"))


def keep_first_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, SO1: a cluster that several folders hold keeps its first folder's tier."""
    o = data.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 700).alias("cluster_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("folder"), F.col("o_orderkey").alias("stem"))
    return o.groupBy("cluster_id").agg(F.min_by(F.struct("folder", "stem"), F.struct("folder", "stem")).alias("f")).select("cluster_id", "f.folder", "f.stem")


def history_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct acts of each pair, as recorded: dates and courts rule none out."""
    return graph(spark, sf_dir).raw_direct.select("actor", "target", "n_links", "worst")


def history_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the chain of every opinion over valid edges."""
    return graph(spark, sf_dir).chains.select("cluster_id", "node", "role")


def history_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, E5: opinions that reach one another over direct history as recorded."""
    return graph(spark, sf_dir).components.select("node", "component")


def history_reach_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, E5: how far direct history as recorded leads from each opinion, over all its
    labels and through cycles; reach is kept for each component."""
    g = graph(spark, sf_dir)
    nodes = g.opinions.select(F.col("cluster_id").alias("node")).unionByName(g.raw_direct.select(F.explode(F.array("actor", "target")).alias("node"))).distinct()
    return condense.reach_counts(nodes, g.components, g.raw_reach)


def history_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the opinions of every chain of two or more."""
    g = graph(spark, sf_dir)
    m = history.members(g.chains, g.chains.select("cluster_id").distinct(), data.opinions(spark, sf_dir), g.courts)
    return history.layout(history.placed_members(m)).select("cluster_id", "node", "role", "at", "row", "col", "tier", "dir", "col_start", "col_end", "span")


def history_layout_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chains: opinions, decisions below and cards of
    reported acts on one grid, with what each decision did."""
    nodes, links, _ = graph(spark, sf_dir).whole_chains
    grid = history.laid_out(nodes, links)
    said = F.array_join(F.transform("acts", lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["treatment"], F.lit("="), x["defined_as"], F.lit(":"), x["severity"], F.lit(":"), x["text"])), ", ")), " / ")
    return grid.select("cluster_id", "at", "role", "node", "case_name", F.col("court_display").alias("court"), F.col("level").cast("int").alias("level"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "tier", "dir", F.coalesce(said, F.lit("")).alias("acts"), "n_opinions", "has_reported")


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions of every chain, and whether a reported act is drawn on it."""
    g = graph(spark, sf_dir)
    # The first event of a chain is always drawn.
    told = g.events.select("cluster_id", F.lit(True).alias("told")).distinct()
    n = g.places.groupBy("cluster_id").agg(F.count("node").alias("n_opinions"))
    return n.join(told, "cluster_id", "left").select("cluster_id", "n_opinions", F.coalesce("told", F.lit(False)).alias("has_reported"))


def reported_acts_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6, J13, SO5, G10: reported acts that no recorded act covers."""
    return graph(spark, sf_dir).reports.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("citing").alias("n_citing"))


def drawn_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported acts drawn on every chain."""
    return history.drawn_events(graph(spark, sf_dir).events).select("cluster_id", "target", "citing", "court", F.size("treatments").alias("n"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, n): every label of the edges, as recorded, and how many edges have it."""
    return graph(spark, sf_dir).recorded.groupBy(F.col("treatment").alias("label")).agg(F.count("*").alias("n"))


def treatment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of every label that edges have."""
    x = F.col("label")
    return _labels(spark, sf_dir).select(x, "n", tax.is_recognized(x).alias("recognized"), tax.base(x).alias("base"), tax.past(x).alias("past"), tax.severity(x).alias("severity"), tax.rank(tax.severity(x)).alias("rank"), tax.active(x).alias("active"), tax.recognizes(x).alias("recognizes"), tax.recognized_form(x).alias("reported_as"), tax.direction(x).alias("direction"), tax.has_evidence(x).alias("evidence"), tax.is_direct(x).alias("direct"), tax.is_negative(tax.severity(x)).alias("negative"))


def treatment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by tier, and the labels of direct history and of references among them."""
    labels = _labels(spark, sf_dir).filter(~tax.is_recognized(F.col("label"))).join(tax.dim_treatment(spark).select("label", "ord"), "label")
    of = lambda direct: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(tax.is_direct(F.col("label")) == F.lit(direct), F.struct("ord", "label")))), lambda x: x["label"]), "|")
    return labels.groupBy(tax.severity(F.col("label")).alias("severity")).agg(of(True).alias("direct_history"), of(False).alias("citing_reference"), F.sum("n").cast("long").alias("n"))


def treatment_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of the labels that edges have, as the pills of their rows show them."""
    return _labels(spark, sf_dir).join(tax.definitions(spark).withColumnRenamed("form", "label"), "label").select(F.col("label").alias("form"), "definition", "n")


def disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions by priority and status of orders."""
    o = data.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    label = F.when(k % 5 == 0, "Affirmed").when(k % 5 == 1, "Reversed and remanded").when(k % 5 == 2, " Modified ").when(k % 5 == 3, "None").otherwise(F.lit(None))
    said = F.when(k % 3 == 0, F.concat(F.lit("Motion "), "o_orderstatus")).otherwise("")
    o = o.select(F.col("o_orderkey").alias("cluster_id"), text.disposition_treatment(label, said).alias("t"), text.disposition_label(label, said).alias("d"))
    return o.select("cluster_id", F.col("t.treatment").alias("treatment"), F.col("t.severity").alias("severity"), F.col("d.label").alias("label"), F.col("d.text").alias("said"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names and citations."""
    p = data.table(spark, sf_dir, "part")
    name, cite = F.concat("p_name", F.lit(" v. "), "p_brand"), F.concat("p_size", F.lit(" U. S. "), "p_partkey", F.lit(", at 3"))
    return p.select("p_partkey", text.cite_key(cite).alias("cite_key"), text.short_name(name).alias("short_name"), text.quote_name_key(name).alias("quote_key"), text.section_anchor(name).alias("anchor"), text.name_order(name)["name"].alias("name_key"), F.array_join(F.array_sort(F.array_distinct(text.case_name_words(name))), " ").alias("words"))


def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: how many tokens every document has, and their digest."""
    d = data.table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt of every document."""
    d = data.table(spark, sf_dir, "documents")
    paragraphs = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda p: p != "")
    return d.select("doc_id", F.md5(text.excerpt(paragraphs)).alias("digest"), F.length(text.excerpt(paragraphs)).cast("long").alias("n_chars"))


def writing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writings with one title are numbered."""
    c = data.table(spark, sf_dir, "conversations")
    of = history.Window.partitionBy("conv_id", "role")
    place = F.row_number().over(of.orderBy("turn"))
    n = F.count("*").over(history.Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", F.when((n > 1) & (place > 1), F.concat(F.initcap("role"), F.lit(" "), place.cast("string"))).otherwise(F.initcap("role")).alias("title"))


def mention_navigator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of mentions among those of the same authority."""
    m = data.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("n"), F.struct(*data.ORDER).alias("pos"))
    return search.mentions(m).groupBy("cluster_id", "n").agg(F.max("occurrence").cast("long").alias("last"), F.max("total").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        later_courts_status, status_passages, severity_summary, later_courts_rows, later_courts_pills, later_courts_ranks, later_courts_ranks_hubs, list_sort_court, pill_validation,
        edge_validation, court_relation, court_list, court_picker, edges_all, resolve_groups, cite_owners, name_owners,
        authority_rows, authority_ranks, authority_ranks_hubs, page_bodies, authority_meta, scope_counts, index_entries, home_search, home_search_page2, home_search_counts,
        index_order, opinion_index_union, keep_first_tier, history_edges, history_reach, history_components, history_reach_raw, history_summary, history_chain, history_layout_full, reported_acts_antijoin, drawn_reports,
        treatment_labels, treatment_table, treatment_definitions, disposition, text_keys, token_streams, excerpts, writing_titles, mention_navigator,
    )
}


# ------------------------------------------------------------ quotes and documents
def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quotes of every document that holds their first words."""
    docs = data.table(spark, sf_dir, "documents").select("doc_id", "text")
    # The words are read twice, so that they stay a projection of their own.
    words = docs.select("doc_id", F.split("text", r"\s+").alias("w"))
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 4), " "))
    keys = words.select("doc_id", F.explode(F.array_distinct(heads)).alias("head"))
    quotes_ = data.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 4), " ").alias("head"))
    return keys.join(quotes_, "head").select("doc_id", "item_id", "quote").distinct().join(docs, "doc_id")


def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3's quick path: documents that hold a passage token by token."""
    q = _quoted(spark, sf_dir)
    return q.select("doc_id", "item_id", quotes.stands_in(F.col("quote"), F.array("text")).alias("found"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages with every document that they may be quoted from."""
    texts = data.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    quoted = data.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return quotations.candidates(quoted, texts, "item_id", "quote", "doc_id", "text")


def verify_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: status of every passage in the documents that hold a run of it, changed words,
    case and gaps included."""
    return _passages(spark, sf_dir).select("doc_id", "item_id", quotes.status(F.col("quote"), F.array("text")).alias("status"))


def expand_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q2: whole passages widened to the sentences of the documents that hold them or a run of them."""
    return _passages(spark, sf_dir).select("doc_id", "item_id", quotes.expand_udf(F.split("text", "\n"), "quote").alias("sentences"))


def quote_names_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: whether an order's text names it."""
    o = data.opinions(spark, sf_dir)
    quote = F.concat(F.lit("See "), F.when(F.col("cluster_id") % 3 == 0, F.get("citations", F.lit(1))).when(F.col("cluster_id") % 3 == 1, F.col("case_name")).otherwise("the record"), F.lit(", at 4."))
    return o.select("cluster_id", text.quote_names_case(quote, F.col("citations"), F.col("case_name")).alias("names"))


def mark_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: quotes with the case's name in strong."""
    o = data.opinions(spark, sf_dir)
    quote = F.concat(F.lit('"In <'), F.col("case_name"), F.lit("> ("), F.get("citations", F.lit(1)), F.lit(") & later."))
    return o.select("cluster_id", quotes.mark_udf(quote, "citations", "case_name").alias("marked"))


def quote_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: the block that a passage stands in."""
    q = _quoted(spark, sf_dir)
    return q.select("doc_id", "item_id", quotes.locate(F.split("text", "\n"), F.col("quote")).alias("block"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 to H4: blocks of every page by type."""
    p = data.table(spark, sf_dir, "pages").select("page_id", documents.blocks_udf("html").alias("d"))
    return p.select("page_id", F.explode("d.blocks").alias("b")).groupBy("page_id", F.col("b.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("b.html")).cast("long").alias("n_chars"))


def html_blocks_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 to H4 in SQL text: blocks of every page by type, from a table function."""
    sql.register(spark)
    pages = data.table(spark, sf_dir, "pages")
    return spark.sql("SELECT p.page_id, b.type, count(*) AS n, cast(sum(length(b.html)) AS bigint) AS n_chars FROM {pages} p, LATERAL html_blocks(p.html) b GROUP BY p.page_id, b.type", pages=pages)


def mark_case_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6 in SQL text: quotes with the case's name in strong."""
    sql.register(spark)
    o = graph(spark, sf_dir).opinions
    return spark.sql("""SELECT cluster_id, mark_case(concat('"In <', case_name, '> (', citations[1], ') & later.'), citations, case_name) AS marked FROM {o}""", o=o)


def cite_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: citations that a source links."""
    o = data.opinions(spark, sf_dir).withColumn("cite", F.get("citations", F.lit(1)))
    source = F.concat(F.lit('<p>See <span class="citation" data-id="1"><a href="/opinion/'), (F.col("cluster_id") % 100).cast("string"), F.lit('/x/" aria-description="Citation for case: '), "case_name", F.lit('">'), "cite", F.lit(", 12</a></span>.</p>"))
    return o.select("cluster_id", F.explode(documents.cite_map_udf(source)).alias("c")).select("cluster_id", "c.cite", F.col("c.target").cast("long").alias("target"), "c.case_name")


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writings of conversations as one document each."""
    c = data.table(spark, sf_dir, "conversations").withColumn("w", F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "user", "040dissent").otherwise("020lead").alias("type"), F.lit("").alias("author"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html")))
    whole = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: F.struct(w["id"].alias("id"), w["type"].alias("type"), w["author"].alias("author"), w["html"].alias("html"))).alias("ws"))
    return whole.select("conv_id", F.posexplode(documents.document_udf("ws")).alias("pos", "d")).select("conv_id", F.col("pos").cast("long").alias("pos"), "d.title", F.size("d.blocks").cast("long").alias("n_blocks"))


def text_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text document of a preamble and a section for its
    source, in which the first word is a citation; links lead to pages of even documents."""
    d = data.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    body = F.coalesce("text", F.lit(""))
    cited = F.concat(F.lit('<citedCase data-cluster-id="'), F.col("doc_id").cast("string"), F.lit('">'), F.coalesce("lang", F.lit("?")), F.lit("</citedCase> "))
    whole = F.concat(F.lit("Of <"), F.coalesce("lang", F.lit("?")), F.lit(">\n\n## "), F.coalesce("source", F.lit("?")), F.lit("\n\n"), cited, body)
    o = d.select(F.col("doc_id").alias("cluster_id"), (F.col("doc_id") % 2 == 0).alias("is_scoped"), documents.string_document(whole).alias("document"))
    return citations.text_bodies(o).select("cluster_id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


QUERIES |= {f.__name__: f for f in (quote_containment, verify_quote, expand_quote, quote_names_case, mark_case, quote_location, html_blocks, html_blocks_sql, mark_case_sql, cite_map, document_titles, text_bodies)}


# ------------------------------------------------------- further scalar operators
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))


def _pick(values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("k") % len(values) + 1).cast("int"))


# Forms of citations and whether each is to a case.
FORMS = [("633 F.3d 894", True), ("Id. at 405", False), ("42 U.S.C. 1983", False), ("Bruton", True), ("see supra note 3", False), ("591 U. S. ___", True), ("the plaintiff moved", False), ("In re Google", True), ("12 Harv. L. Rev. 3", False)]
# Courts as prose names them, with the court and the name that each stands for.
PROSE = [
    ("the United States  Supreme Court", "scotus", "Supreme Court of the United States"),
    ("U. S. Supreme Court", "scotus", "Supreme Court of the United States"),
    ("the Ninth Circuit", "ca9", "Court of Appeals for the Ninth Circuit"),
    ("Federal  Circuit panel", "cafc", "Court of Appeals for the Federal Circuit"),
    (" a trial   court ", "", "a trial court"),
]
# Names with a procedural tag, and without it.
TAGGED = [("Troppi v Scarf (leave denied)", "Troppi v Scarf"), ("A v. B (No. 1)", "A v. B (No. 1)"), ("C v. D (cert. granted) ", "C v. D"), ("E (1999)", "E"), ("F v. G (on appeal) (order)", "F v. G (on appeal)")]


def case_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a citation group refers to a case."""
    none = F.array().cast("array<string>")
    return _orders(spark, sf_dir).select("k", text.is_case_group(F.when(F.col("k") % 11 == 0, "Named").otherwise(""), F.lit(""), F.array(_pick([f for f, _ in FORMS])), none).alias("is_case"))


def canonical_courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts named in prose."""
    c = text.canonical_court(_pick([p for p, _, _ in PROSE]))
    return _orders(spark, sf_dir).select("k", c["court"].alias("court"), c["name"].alias("name"))


def authority_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: names without their procedural tag."""
    return _orders(spark, sf_dir).select("k", text.clean_authority_name(_pick([t for t, _ in TAGGED])).alias("name"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep links from a status to its passage."""
    k = F.col("k")
    return _orders(spark, sf_dir).select("k", text.page_link(k, F.when(k % 3 == 0, k % 7), F.when(k % 3 == 1, F.concat(F.lit("in part "), "status")).otherwise(""), F.when(k % 2 == 0, "missing").otherwise("found")).alias("href"))


def list_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three items of a list and how many follow."""
    items = F.transform(F.sequence(F.lit(1), F.col("k") % 6 + 1), lambda i: i.cast("string"))
    c = text.first_items(items)
    return _orders(spark, sf_dir).select("k", F.array_join(c["shown"], ",").alias("shown"), c["more"].cast("int").alias("more"))


def lead_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card that a navigator shows first."""
    tier = lambda n: F.element_at(F.array(*map(F.lit, ["Neutral", "Stop", "Odd", "Caution"])), ((F.col("k") / n).cast("long") % 4 + 1).cast("int"))
    cards = F.array(*[F.struct(tier(n).alias("severity"), F.lit(i).alias("at")) for i, n in enumerate((1, 4, 16))])
    o = _orders(spark, sf_dir).select("k", cards.alias("cards"))
    return o.select("k", search.lead_card(F.col("cards"))["at"].alias("lead"))


def below_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision below that an opinion reviewed."""
    k = F.col("k")
    entry = lambda c, n: F.struct(c.alias("court"), n.alias("name"))
    entries = F.array(entry(F.lit(""), F.lit("")), entry(F.when(k % 2 == 0, "a court").otherwise(""), F.lit("")), entry(F.lit(""), F.when(k % 3 == 0, "People v. Roe").otherwise("")), entry(F.lit("ct"), F.when(k % 5 == 0, "Smithson matter").otherwise("")))
    found = text.below_entry(entries, F.lit("Smithson v. State"))
    return _orders(spark, sf_dir).select("k", found["court"].alias("court"), found["name"].alias("name"))


def act_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acts that the labels of edges name."""
    return _labels(spark, sf_dir).select("label", "n", F.array_join(text.act_verbs(tax.past(F.col("label"))), "|").alias("verbs"))


def court_typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts and groups that typed text shows."""
    c = court_fn.court_picker(data.courts(spark, sf_dir))
    groups = c.groupBy("tab", "group_name").agg(F.collect_list("display").alias("names"))
    q = F.lit(" AR")
    return groups.select("tab", "group_name", search.group_visible(q, F.col("group_name"), F.col("names")).alias("shown"), F.size(F.filter("names", lambda n: search.court_visible(q, n))).alias("n_courts"))


def citing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the citing scope, by a writing's id or by its cluster."""
    o = data.opinions(spark, sf_dir)
    li = data.table(spark, sf_dir, "lineitem")
    # Writings' ids lie beyond all ids of clusters, whatever the tables' size.
    ids = o.select(F.col("cluster_id").alias("id")).unionByName(li.select(F.col("l_partkey").alias("id"))).agg(F.min("id").alias("least"), F.max("id").alias("most")).head()
    beyond = ids.most - ids.least + 1 if ids.most is not None else 0
    scope = li.select(F.col("l_orderkey").alias("citing_cluster_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") + beyond).alias("anchor_opinion_id"), F.col("l_partkey").alias("anchor_cluster_id"))
    return edges.scope_pairs(scope, o.withColumn("opinion_ids", F.array(F.col("cluster_id") + beyond)))


def last_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of two files, of odd and of even lines, overrides."""
    li = data.table(spark, sf_dir, "lineitem")
    file = lambda n, i: li.filter(F.col("l_linenumber") % 2 == n).groupBy(F.col("l_partkey").alias("cluster_id")).agg(F.count("*").alias("total")).withColumn("file", F.lit(i))
    return file(1, 0).unionByName(file(0, 1)).groupBy("cluster_id").agg(F.max_by("total", "file").alias("total"))


def levels_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of nodes that have none, a level under or over their neighbours."""
    o = _orders(spark, sf_dir)
    k = F.col("k")
    node = lambda at, role, level, acting: F.struct(F.lit(at).alias("at"), F.lit(role).alias("role"), level.cast("int").alias("level"), F.lit(acting).alias("acting_case"), F.lit("").alias("court"))
    nodes = o.select(k.alias("cluster_id"), F.explode(F.array(node(0, "self", k % 3 + 1, ""), node(1, "below", F.lit(99), ""), node(2, "reported", F.lit(99), "a court"), node(3, "reported", F.lit(99), "the United States Supreme Court"))).alias("n")).select("cluster_id", "n.*")
    links = o.select(k.alias("cluster_id"), F.explode(F.array(F.struct(F.lit(0).alias("actor"), F.lit(1).alias("target")), F.struct(F.lit(2).alias("actor"), F.lit(0).alias("target")), F.struct(F.lit(3).alias("actor"), F.lit(0).alias("target")))).alias("e")).select("cluster_id", "e.*")
    return history.placed(nodes, links).select("cluster_id", "at", "level")


def card_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cards of chains say that decisions did."""
    _, links, _ = graph(spark, sf_dir).whole_chains
    # A chain's own opinion is the first of its nodes.
    each = links.select((F.col("actor") == 0).alias("own"), F.explode("links").alias("x"))
    c = history.card_labels(F.col("x.treatment"), F.col("own"))
    return each.groupBy(c["treatment"].alias("treatment"), c["defined_as"].alias("defined_as"), F.col("x.severity").alias("severity")).agg(F.count("*").alias("n"))


QUERIES |= {f.__name__: f for f in (case_groups, canonical_courts, authority_names, page_links, list_clamps, lead_cards, below_entries, act_verbs, court_typeahead, citing_scope, last_counts, levels_placed, card_labels)}
