"""Direct history as recorded, cycles included: its strong components and what they reach.

Opinions that lead to one another in a cycle reach the same others, so reach is kept for
each component, not for each opinion: a chain of an opinion is its component and what that
reaches.  Components are found by colours.  Edges whose start nothing leads to, or whose end
leads nowhere, are in no cycle and are cut off in turns.  Then every opinion takes the
greatest id that leads to it; those of one colour that lead back to the id it is named by
are a component, and what is left of each colour goes on.  All steps are joins over tables
in the shared folder, several hops in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juriscope.sources.scratch import written


def _trimmed(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) without those that are in no cycle because one of their ends is an
    end of all."""
    n = pairs.count()
    while n:
        for _ in range(2):
            starts, ends = pairs.select("u").distinct(), pairs.select("v").distinct()
            pairs = pairs.join(starts.withColumnRenamed("u", "v"), "v", "left_semi").join(ends.withColumnRenamed("v", "u"), "u", "left_semi").select("u", "v")
        pairs = written(pairs, "trimmed")
        before, n = n, pairs.count()
        if n == before:
            break
    return pairs


def _colours(pairs: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that leads to each node, or the node itself."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = written(ends.select("node", F.col("node").alias("colour"), F.col("node").alias("was")), "colours")
    while True:
        state = now.select("node", "colour")
        for _ in range(2):
            led = pairs.join(state.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("led"))
            state = state.join(led, "node", "left").select("node", F.greatest("colour", "led").alias("colour"))
            # What leads to the node that a colour is named by leads here too.
            far = state.select(F.col("node").alias("colour"), F.col("colour").alias("far"))
            state = state.join(far, "colour").select("node", F.greatest("colour", "far").alias("colour"))
        now = written(state.join(now.select("node", F.col("colour").alias("was")), "node"), "colours")
        if now.filter("colour <> was").isEmpty():
            return now.select("node", "colour")


def _leading_back(pairs: DataFrame, colours: DataFrame) -> DataFrame:
    """The nodes that lead to the node that their colour is named by, within the colour."""
    front = seen = written(colours.filter("node = colour").select("node"), "members")
    while True:
        one = pairs.join(front.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node")).distinct()
        two = pairs.join(one.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"))
        front = written(one.unionByName(two).distinct().join(seen, "node", "left_anti"), "members")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are in a cycle of ``pairs`` (actor, target); a
    component is named by its least node. Others are components of their own."""
    left = written(pairs.select(F.col("actor").alias("u"), F.col("target").alias("v")).filter("u <> v").distinct(), "pairs")
    found = []
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        colours = _colours(left)
        side = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"of_{c}"))  # noqa: B023, E731
        same = written(left.join(side("u"), "u").join(side("v"), "v").filter("of_u = of_v").select("u", "v"), "same")
        back = _leading_back(same, colours)
        mine = colours.join(back, "node")
        found.append(written(mine.join(mine.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("k")).filter("k > 1"), "colour").select("node", "component"), "components"))
        left = written(same.join(back.withColumnRenamed("node", "u"), "u", "left_anti").join(back.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"), "left")
    if not found:
        return pairs.select(F.col("actor").alias("node"), F.col("actor").alias("component")).limit(0)
    return reduce(DataFrame.unionByName, found)


def condensed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(upper, lower): ``pairs`` between components."""
    for side, name in (("actor", "upper"), ("target", "lower")):
        of = members.select(F.col("node").alias(side), "component")
        pairs = pairs.join(of, side, "left").withColumn(name, F.coalesce("component", side)).drop("component")
    return pairs.select("upper", "lower").filter("upper <> lower").distinct()


def closure(steps: DataFrame) -> DataFrame:
    """(upper, lower): all that each component reaches over ``steps``, which have no cycle.
    Components that nothing leads to come last and in one step: most are of that kind."""
    inner = steps.join(steps.select(F.col("lower").alias("upper")).distinct(), "upper", "left_semi")
    on = steps.select(F.col("upper").alias("lower"), F.col("lower").alias("next"))
    front = seen = written(inner.select("upper", "lower"), "reach")
    hop = lambda x: x.join(on, "lower").select("upper", F.col("next").alias("lower"))
    while True:
        one = hop(front).distinct()
        front = written(one.unionByName(hop(one)).distinct().join(seen, ["upper", "lower"], "left_anti"), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    first = steps.join(inner.select("upper").distinct(), "upper", "left_anti")
    below = seen.select(F.col("upper").alias("lower"), F.col("lower").alias("next"))
    return seen.unionByName(first.unionByName(first.join(below, "lower").select("upper", F.col("next").alias("lower"))).distinct())


def reach_counts(nodes: DataFrame, members: DataFrame, reach: DataFrame) -> DataFrame:
    """(node, component, n_component, n_below, n_above): how many opinions each opinion's
    component has, and how many others it reaches downwards, its own among them, and upwards
    only. ``nodes``: node."""
    own = nodes.join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = own.groupBy("component").agg(F.count("*").alias("n_component"))
    size = lambda c: sizes.select(F.col("component").alias(c), F.col("n_component").alias("n"))
    below = reach.join(size("lower"), "lower").groupBy(F.col("upper").alias("component")).agg(F.sum("n").alias("b"))
    above = reach.join(size("upper"), "upper").groupBy(F.col("lower").alias("component")).agg(F.sum("n").alias("a"))
    told = sizes.join(below, "component", "left").join(above, "component", "left")
    none = F.lit(0).cast("long")
    told = told.select("component", "n_component", (F.coalesce("b", none) + F.col("n_component") - 1).alias("n_below"), F.coalesce("a", none).alias("n_above"))
    return own.join(told, "component").select("node", "component", "n_component", "n_below", "n_above")
