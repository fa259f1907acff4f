"""Registered queries work on all of their tables: against brute-force versions."""

from collections import defaultdict

from juriscope.functions import taxonomy as tax
from juriscope.functions.text import act_verbs, canonical_court
from juriscope.operators import edges
from juriscope.plans import queries
from juriscope.plans import indexes
from juriscope.sources import testdata as data
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_levels_of_every_order(spark):
    keys = [r.o_orderkey for r in data.table(spark, SF, "orders").select("o_orderkey").collect()]
    want = sorted((k, at, level) for k in keys for at, level in enumerate((k % 3 + 1, min(k % 3 + 2, 4), k % 3, 0)))
    assert sorted(map(tuple, queries.levels_placed(spark, SF).collect())) == want


def slow_drawn(spark):
    """Reported acts drawn one chain after the other, for each opinion that there is."""
    views, pairs = indexes.graph(spark, SF).views, indexes.graph(spark, SF).direct
    below, above = defaultdict(set), defaultdict(set)
    for r in pairs.select("actor", "target").collect():
        below[r.actor].add(r.target)
        above[r.target].add(r.actor)
    known = defaultdict(list)
    for r in pairs.select("actor", "target", F.explode("links").alias("l")).select("actor", "target", act_verbs(F.regexp_replace("l.treatment", " by$", "")).alias("v")).collect():
        known[r.target].append((r.actor, set(r.v)))
    by_target = defaultdict(lambda: defaultdict(list))
    name = canonical_court(F.col("acting_case"))["name"]
    acts = edges.reported_acts(views).select("*", act_verbs(tax.past(F.col("treatment"))).alias("v"), F.concat(tax.past(F.col("treatment")), F.lit(" by")).alias("shown"), tax.rank(F.col("severity")).alias("rank"), name.alias("name"))
    for r in acts.collect():
        by_target[r.cited][r.citing].append(r)
    dates = {r.cluster_id: r.date_filed for r in data.opinions(spark, SF).select("cluster_id", "date_filed").collect()}
    out = []
    for seed in dates:
        chain = {seed}
        for graph in (below, above):
            queue, reached = [seed], {seed}
            while queue:
                for x in graph[queue.pop()] - reached:
                    reached.add(x)
                    queue.append(x)
            chain |= reached
        events = []
        for target in chain & set(by_target) & set(dates):
            for citing, every in by_target[target].items():
                # Only links between members of this chain put an act on record here.
                rows = [r for r in every if not any(set(r.v) <= v for actor, v in known[target] if actor in chain & set(dates))]
                if not rows:
                    continue
                first = min(rows, key=lambda r: tuple(r.edge_ord))
                labels = dict.fromkeys(r.shown for r in sorted(rows, key=lambda r: (r["rank"], tuple(r.edge_ord), r.shown)))
                events.append((first.citing_date_filed, dates[target], (target != seed, target), tuple(first.edge_ord), target, citing, first.citing_case_name, first.name or "Court not identified", list(labels)))
        drawn, cards = set(), defaultdict(set)
        for date, _, _, _, target, citing, case, court, labels in sorted(events, key=lambda e: e[:4]):
            fresh = [t for t in labels if (target, t) not in drawn and t not in cards[case, date]]
            if fresh:
                cards[case, date] |= set(fresh)
                drawn |= {(target, t) for t in fresh}
                out.append((seed, target, citing, court, len(fresh)))
    return out


def test_reports_on_every_chain(spark):
    want = sorted(slow_drawn(spark))
    assert sorted(map(tuple, queries.drawn_reports(spark, SF).collect())) == want
    tiers = {r.cluster_id: r.tier for r in data.opinions(spark, SF).select("cluster_id", "tier").collect()}
    assert {tiers[w[0]] for w in want} == {"anchor", "authority", "citing"}
