"""Appellate chains: reachability over direct history, recorded and reported acts,
and the grid that a chain is drawn on.

A chain's nodes are of three kinds: opinions, decisions below that opinions name (one node
for each court and name), and cards of opinions that report an act.  They are numbered
within the chain: opinions (the chain's own first, then by id), decisions below in the
order in which opinions name them, cards in the order in which they are drawn.  Edges and
levels are columns over that numbering; only which reported acts are drawn is decided one
after the other, over the sorted acts of one chain.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriscope.functions import taxonomy as tax
from juriscope.functions.text import act_verbs, below_entry, canonical_court, disposition_treatment, names_supreme_court, or_empty
from juriscope.sources.scratch import written

UNKNOWN, LOWEST, FIRST_COLUMN = 99, 4, 3


def hop(front: DataFrame, step: DataFrame) -> DataFrame:
    """(cluster_id, node): one step on from ``front`` (cluster_id, node)."""
    return front.join(step, "node").select("cluster_id", F.col("next").alias("node"))


def reach(down: DataFrame, up: DataFrame, seeds: DataFrame) -> DataFrame:
    """G1: (cluster_id, node, role): all that direct history leads to from each seed,
    down (below) and up (above) apart; below wins. ``down`` and ``up`` hold the same pairs
    (actor, target), by actor and by target, so that only the frontier is sent to them.

    Every round takes two steps and anti-joins what they meet with what is known, so a node
    is met once however many paths lead to it, cycles end, and the loop stops when nothing
    is new."""
    found = None
    for role, pairs, a, b in (("below", down, "actor", "target"), ("above", up, "target", "actor")):
        step = pairs.select(F.col(a).alias("node"), F.col(b).alias("next"))
        seen = seeds.select("cluster_id", F.col("cluster_id").alias("node")).distinct()
        front = seen
        while True:
            one = hop(front, step).distinct()
            new = one.unionByName(hop(one, step)).distinct().join(seen, ["cluster_id", "node"], "left_anti")
            front = written(new, "frontier")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        side = seen.filter("node <> cluster_id").withColumn("role", F.lit(role))
        found = side if found is None else found.unionByName(side.join(found, ["cluster_id", "node"], "left_anti"))
    return found


def reach_of_all(down: DataFrame) -> DataFrame:
    """``reach`` of every opinion at once, over pairs (actor, target) without cycles, by
    actor: what one opinion has below it has that opinion above."""
    step = down.select(F.col("actor").alias("node"), F.col("target").alias("next"))
    seen = front = down.select(F.col("actor").alias("cluster_id"), F.col("target").alias("node"))
    while True:
        front = written(hop(front, step).distinct().join(seen, ["cluster_id", "node"], "left_anti"), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    above = seen.select(F.col("node").alias("cluster_id"), F.col("cluster_id").alias("node"), F.lit("above").alias("role"))
    return seen.withColumn("role", F.lit("below")).unionByName(above)


def members(chains: DataFrame, seeds: DataFrame, opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """The opinion nodes of each chain with court, level and date; the seed is ``self``."""
    nodes = seeds.select("cluster_id", F.col("cluster_id").alias("node"), F.lit("self").alias("role")).unionByName(chains.select("cluster_id", "node", "role"))
    about = opinions.select(F.col("cluster_id").alias("node"), "case_name", "court", "date_filed").join(courts.select("court", "display", "level", "category", F.coalesce("last_resort", F.lit(False)).alias("last_resort")), "court", "left")
    return nodes.join(about, "node").withColumns({"level": F.coalesce("level", F.lit(UNKNOWN)), "court_display": F.coalesce("display", "court")}).drop("display")


def recorded(chain_members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster_id, actor, target, links): direct acts between members of a chain."""
    side = lambda name: chain_members.select("cluster_id", F.col("node").alias(name))
    return pairs.join(side("actor"), "actor").join(side("target"), ["cluster_id", "target"]).select("cluster_id", "actor", "target", "links")


def decisions_below(chain_members: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """For members that act on nothing: the decision that they say they reviewed,
    with the disposition. ``records``: node, case_name, on_appeal, disposition."""
    idle = chain_members.select("cluster_id", "node").join(edges.select("cluster_id", F.col("actor").alias("node")).distinct(), ["cluster_id", "node"], "left_anti")
    entry = below_entry(F.col("on_appeal"), F.col("case_name"))
    found = idle.join(records.select("node", entry.alias("entry"), disposition_treatment(F.col("disposition.label"), F.col("disposition.text")).alias("did")), "node").filter("entry is not null")
    return found.select("cluster_id", F.col("node").alias("actor"), or_empty(F.col("entry.court")).alias("court"), or_empty(F.col("entry.name")).alias("case_name"), or_empty(F.col("entry.quote")).alias("quote"), F.col("did.treatment").alias("treatment"), F.col("did.severity").alias("severity"), F.col("did.text").alias("text"))


def unrecorded_reports(reports: DataFrame, edges: DataFrame) -> DataFrame:
    """J13, SO5: reports whose acts no single recorded link on their target covers.
    ``reports``: target, treatment, ...; ``edges``: target, links."""
    on_record = edges.select("target", F.explode("links").alias("l")).select("target", act_verbs(F.regexp_replace("l.treatment", " by$", "")).alias("known")).distinct()
    verbs = act_verbs(tax.past(F.col("treatment")))
    r = reports.withColumn("verbs", verbs)
    return r.join(on_record, (r.target == on_record.target) & (F.size(F.array_except("verbs", "known")) == 0), "left_anti")


def placed_members(chain_members: DataFrame) -> DataFrame:
    """``members`` numbered: the chain's own opinion, then the others by id."""
    order = Window.partitionBy("cluster_id").orderBy(F.when(F.col("role") == "self", 0).otherwise(1), "node")
    return chain_members.withColumn("at", F.row_number().over(order) - 1)


def report_events(reports: DataFrame, numbered: DataFrame, chain_edges: DataFrame | None = None) -> DataFrame:
    """What one opinion reports of one decision of a chain, in the order of
    drawing: (cluster_id, ord, at, target, citing, case_name, date_filed, acting_case, court,
    court_id, treatments). Acts that a recorded link of the chain covers are left out;
    ``chain_edges``: cluster_id, target (number), links."""
    here = numbered.select("cluster_id", "at", F.col("node").alias("target"), F.col("date_filed").alias("target_date"))
    r = reports.join(here, "target").withColumn("verbs", act_verbs(tax.past(F.col("treatment"))))
    if chain_edges is not None:
        known = chain_edges.select(F.col("cluster_id").alias("_c"), F.col("target").alias("_t"), F.explode("links").alias("l")).select("_c", "_t", act_verbs(F.regexp_replace("l.treatment", " by$", "")).alias("known")).distinct()
        r = r.join(known, (F.col("cluster_id") == F.col("_c")) & (F.col("at") == F.col("_t")) & (F.size(F.array_except("verbs", "known")) == 0), "left_anti")
    label = F.concat(tax.past(F.col("treatment")), F.lit(" by"))
    court = canonical_court(F.col("acting_case"))
    events = r.groupBy("cluster_id", "at", "target", "citing", "target_date").agg(
        F.array_sort(F.collect_list(F.struct(tax.rank(F.col("severity")).alias("rank"), "edge_ord", label.alias("treatment")))).alias("links"),
        F.min_by(F.struct("citing_case_name", "citing_date_filed", "acting_case", F.coalesce(F.nullif(court["name"], F.lit("")), F.lit("Court not identified")).alias("court"), F.coalesce(court["court"], F.lit("")).alias("court_id")), "edge_ord").alias("by"),
        F.min("edge_ord").alias("first_ord"),
    )
    order = Window.partitionBy("cluster_id").orderBy("by.citing_date_filed", or_empty(F.col("target_date")), "at", "first_ord")
    events = events.withColumn("ord", F.row_number().over(order))
    return events.select("cluster_id", "ord", "at", "target", "citing", F.col("by.citing_case_name").alias("case_name"), F.col("by.citing_date_filed").alias("date_filed"), F.col("by.acting_case").alias("acting_case"), F.col("by.court").alias("court"), F.col("by.court_id").alias("court_id"), F.array_distinct(F.transform("links", lambda x: x["treatment"])).alias("treatments"))


def _draw(chains: pd.Series) -> pd.Series:
    """An act is drawn of a decision once, and on a card once."""

    def one(events) -> list[dict]:
        claimed: set[tuple] = set()
        cards: dict[tuple, int] = {}
        out = []
        for e in events:
            who = ("card", e["case_name"], e["date_filed"])
            keys = {t: {("target", e["at"], t), (*who, t)} for t in e["treatments"]}
            fresh = [t for t, k in keys.items() if not k & claimed]
            if fresh:
                claimed.update(*(keys[t] for t in fresh))
                out.append({"ord": e["ord"], "card": cards.setdefault(who, len(cards)), "fresh": fresh})
        return out

    return pd.Series([one(events) for events in chains], dtype=object)


def drawn_events(events: DataFrame) -> DataFrame:
    """The events that are drawn, with the number of their card and what is new of them."""
    whole = events.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("ord", "at", "case_name", "date_filed", "treatments"))).alias("events"))
    drawn = whole.select("cluster_id", F.explode(F.pandas_udf(_draw, "array<struct<ord:int,card:int,fresh:array<string>>>")("events")).alias("d")).select("cluster_id", "d.*")
    return events.drop("treatments").join(drawn, ["cluster_id", "ord"]).withColumnRenamed("fresh", "treatments")


def placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of each chain with a level for those without: a decision below stands
    one under the lowest that acts on it, a reported act one above the highest that
    it concerns, the Supreme Court on top. Levels that are found count for the nodes that
    follow. ``nodes``: cluster_id, at (from 0, without gaps), role, level, acting_case, court;
    ``edges``: cluster_id, actor, target (places in the chain)."""
    beside = lambda a, b, name: edges.groupBy("cluster_id", F.col(a).alias("at")).agg(F.collect_list(b).alias(name))
    known = nodes.join(beside("actor", "target", "acts_on"), ["cluster_id", "at"], "left").join(beside("target", "actor", "acted_by"), ["cluster_id", "at"], "left")
    reported = F.col("role") == "reported"
    near = F.coalesce(F.when(reported, F.col("acts_on")).otherwise(F.col("acted_by")), F.array().cast("array<int>"))
    top = reported & names_supreme_court(F.concat_ws(" ", "acting_case", "court"))
    rows = known.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("level").cast("int").alias("level"), reported.alias("reported"), top.alias("top"), near.cast("array<int>").alias("near")))).alias("rows"))

    def place(levels: Column, n: Column) -> Column:
        found = F.filter(F.transform(n["near"], lambda i: F.get(levels, i)), lambda x: x < UNKNOWN)
        none = F.size(found) == 0
        above = F.when(n["top"] | none, 0).otherwise(F.greatest(F.array_min(found) - 1, F.lit(0)))
        level = F.when(n["reported"], above).otherwise(F.when(none, LOWEST).otherwise(F.least(F.array_max(found) + 1, F.lit(LOWEST))))
        return F.when(n["level"] < UNKNOWN, levels).otherwise(F.transform(levels, lambda x, i: F.when(i == n["at"], level).otherwise(x)))

    levels = rows.select("cluster_id", F.posexplode(F.aggregate("rows", F.transform("rows", lambda n: n["level"]), place)).alias("at", "level"))
    return nodes.drop("level").join(levels, ["cluster_id", "at"])


def whole_chain(chain_members: DataFrame, pairs: DataFrame, records: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes (cluster_id, at, role, node, case_name, court, court_display,
    level, category, last_resort, date_filed, acting_case) and edges (cluster_id, actor,
    target, kind, ord, links) of every chain. ``pairs``: actor, target, links, first_ord;
    ``records``: node, case_name, on_appeal, disposition; ``reports``: valid reported acts.
    And the reported acts that are drawn: cluster_id, target, citing, court, treatments."""
    m = written(placed_members(chain_members), "chain_members")
    side = lambda name: m.select("cluster_id", F.col("node").alias(name), F.col("at").alias(f"{name}_at"))
    own = pairs.join(side("actor"), "actor").join(side("target"), ["cluster_id", "target"])
    link = lambda x, text: F.struct(x["treatment"].alias("treatment"), x["severity"].alias("severity"), text.alias("text"))
    nth = F.row_number().over(Window.partitionBy("cluster_id", "actor_at").orderBy("first_ord"))
    recorded_edges = own.select("cluster_id", F.col("actor_at").alias("actor"), F.col("target_at").alias("target"), F.lit(0).alias("kind"), nth.alias("ord"), F.transform("links", lambda x: link(x, F.lit(""))).alias("links"))
    recorded_edges = written(recorded_edges, "recorded")
    # Decisions below that opinions name which act on nothing here.
    idle = m.select("cluster_id", "at", "node").join(recorded_edges.select("cluster_id", F.col("actor").alias("at")).distinct(), ["cluster_id", "at"], "left_anti")
    entry = below_entry(F.col("on_appeal"), F.col("case_name"))
    did = disposition_treatment(F.col("disposition.label"), F.col("disposition.text"))
    named = idle.join(records.select("node", entry.alias("entry"), did.alias("did")), "node").filter("entry IS NOT NULL")
    named = named.select("cluster_id", "at", or_empty(F.col("entry.court")).alias("court_display"), or_empty(F.col("entry.name")).alias("case_name"), "did")
    sizes = m.groupBy("cluster_id").agg(F.count("*").cast("int").alias("n"))
    below = named.groupBy("cluster_id", "court_display", "case_name").agg(F.min("at").alias("first")).join(sizes, "cluster_id")
    below = below.withColumn("target", (F.col("n") + F.row_number().over(Window.partitionBy("cluster_id").orderBy("first")) - 1).cast("int"))
    below = written(below.select("cluster_id", "court_display", "case_name", "target"), "below")
    no_links = F.array().cast("array<struct<treatment:string,severity:string,text:string>>")
    below_edges = named.join(below, ["cluster_id", "court_display", "case_name"]).select("cluster_id", F.col("at").alias("actor"), "target", F.lit(1).alias("kind"), F.lit(0).alias("ord"), F.when(F.col("did").isNull(), no_links).otherwise(F.array(link(F.col("did"), F.col("did.text")))).alias("links"))
    # Cards of reported acts.
    drawn = drawn_events(written(report_events(reports, m, recorded_edges), "events"))
    first = sizes.join(below.groupBy("cluster_id").agg(F.count("*").cast("int").alias("k")), "cluster_id", "left").select("cluster_id", (F.col("n") + F.coalesce("k", F.lit(0))).alias("first"))
    drawn = written(drawn.join(first, "cluster_id").withColumn("actor", F.col("first") + F.col("card")), "drawn")
    cards = drawn.groupBy("cluster_id", F.col("actor").alias("at")).agg(F.min_by(F.struct("case_name", "court", "court_id", "date_filed", "acting_case"), "ord").alias("by")).select("cluster_id", "at", "by.*")
    report_edges = drawn.select("cluster_id", "actor", F.col("at").alias("target"), F.lit(2).alias("kind"), "ord", F.transform("treatments", lambda t: F.struct(t.alias("treatment"), tax.severity(t).alias("severity"), F.lit("").alias("text"))).alias("links"))
    none = F.lit(None)
    typed = lambda df, role, **c: df.select("cluster_id", "at", role.alias("role"), *[c.get(x, F.col(x)).alias(x) for x in ("node", "case_name", "court", "court_display", "level", "category", "last_resort", "date_filed", "acting_case")])
    unplaced = {"node": none.cast("bigint"), "level": F.lit(UNKNOWN), "category": none.cast("string"), "last_resort": F.lit(False)}
    nodes = typed(m, F.col("role"), acting_case=F.lit(""))
    nodes = nodes.unionByName(typed(below.withColumnRenamed("target", "at"), F.lit("below"), court=F.lit(""), date_filed=F.lit(""), acting_case=F.lit(""), **unplaced))
    nodes = nodes.unionByName(typed(cards, F.lit("reported"), court=F.col("court_id"), court_display=F.col("court"), **unplaced))
    return nodes, recorded_edges.unionByName(below_edges).unionByName(report_edges), drawn.select("cluster_id", "target", "citing", "court", "treatments")


def laid_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The grid of every chain of two nodes and more, with what each card says
    that its decision did: acts, an array of the labels of one edge each."""
    shown = placed(nodes.select("cluster_id", "at", "role", "level", F.col("acting_case"), F.col("court_display").alias("court")), edges.select("cluster_id", "actor", "target")).select("cluster_id", "at", "level")
    own = nodes.select("cluster_id", F.col("at").alias("actor"), (F.col("role") == "self").alias("own"))

    def labelled(x: Column) -> Column:
        c = card_labels(x["treatment"], F.col("own"))
        return F.struct(c["treatment"].alias("treatment"), c["defined_as"].alias("defined_as"), x["severity"].alias("severity"), x["text"].alias("text"))

    acts = edges.filter(F.size("links") > 0).join(own, ["cluster_id", "actor"]).select("cluster_id", F.col("actor").alias("at"), F.struct("kind", "ord", F.transform("links", labelled).alias("labels")).alias("act"))
    acts = acts.groupBy("cluster_id", "at").agg(F.transform(F.array_sort(F.collect_list("act")), lambda a: a["labels"]).alias("acts"))
    grid = layout(nodes.drop("level").join(shown, ["cluster_id", "at"])).join(acts, ["cluster_id", "at"], "left")
    chain = Window.partitionBy("cluster_id")
    grid = grid.withColumns({"n_nodes": F.count("*").over(chain), "n_opinions": F.count("node").over(chain), "has_reported": F.bool_or(F.col("role") == "reported").over(chain)})
    return grid.filter("n_nodes > 1").drop("n_nodes")


def layout(nodes: DataFrame) -> DataFrame:
    """Each node's grid cell and its connector from the one before
    it in time. ``nodes``: cluster_id, at, role, level, date_filed, court, category, last_resort."""
    chain = Window.partitionBy("cluster_id")
    when = F.when(or_empty(F.col("date_filed")) != "", F.col("date_filed")).when(F.col("role") == "below", "").otherwise("9999")
    time = chain.orderBy(when, "at")
    rung = Window.partitionBy("cluster_id", "level")
    n = nodes.withColumns({"row": (F.count("*").over(chain) - F.row_number().over(time)) * 2 + 1, "col": (FIRST_COLUMN + F.dense_rank().over(chain.orderBy(F.col("level").desc())) - 1).cast("int")})
    known = or_empty(F.col("court")) != ""  # decisions below and some reports name no court of the collection
    every = lambda c: (F.count_if(known).over(rung) > 0) & (F.count_if(known & ~F.coalesce(c, F.lit(False))).over(rung) == 0)
    label = (
        F.when(F.col("level") == 0, "Highest court")
        .when((F.col("level") == 1) & every(F.coalesce("last_resort", F.lit(False))), "Court of last resort")
        .when(F.col("level") == 1, "Appellate court")
        .when((F.col("level") == 2) & every(F.col("category") == "state_appellate"), "Intermediate appellate court")
        .otherwise("Trial court")
    )
    n = n.withColumn("tier", label)
    # The label of the next rung up: the least column above this one's.
    above = F.min(F.struct("col", "tier")).over(chain.orderBy("col").rangeBetween(1, 1))
    n = n.withColumns({"tier": F.when(above["tier"] == F.col("tier"), "Lower court").otherwise(F.col("tier")), "prev_col": F.lag("col").over(time)})
    return n.withColumns(
        {
            "dir": F.when(F.col("prev_col").isNull(), None).when(F.col("col") > F.col("prev_col"), "up").when(F.col("col") < F.col("prev_col"), "down").otherwise("same"),
            "col_start": F.least("prev_col", F.when(F.col("prev_col").isNotNull(), F.col("col"))),
            "col_end": F.when(F.col("prev_col").isNotNull(), F.greatest("prev_col", "col") + 1),
            "span": F.abs(F.col("col") - F.col("prev_col")) + 1,
        }
    ).drop("prev_col")


def summary(nodes: DataFrame) -> DataFrame:
    """Opinions of each chain, and whether it shows a reported act."""
    return nodes.groupBy("cluster_id").agg(F.count("node").alias("n_opinions"), F.bool_or(F.col("role") == "reported").alias("has_reported"))


def card_labels(treatment: Column, own: Column) -> Column:
    """struct(treatment, defined_as) of an act on a card."""
    return F.struct(tax.active(treatment).alias("treatment"), F.when(own, tax.active(treatment)).otherwise(F.regexp_replace(treatment, " by$", "")).alias("defined_as"))
