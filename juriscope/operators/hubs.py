"""Places within groups, one of which may hold a third of all rows.

A window holds a group in one task.  Groups of more than ``most`` rows are placed in two
phases instead: their rows are cut into ranges of (group, keys) and sorted, so that a row's
place in its range is known from its position in the file, and what the group's earlier
ranges hold is added.  Both ways give the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriscope.sources.scratch import written

#: Rows of a group that one task sorts, at most.
HUB = 1_000_000


def hubs(rows: DataFrame, group: str, most: int = HUB) -> DataFrame:
    """Groups of more than ``most`` rows, so fewer than one for each ``most`` rows."""
    return rows.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(group)


def _in_windows(rows: DataFrame, group: str, first: tuple[str, list[Column]], others: dict[str, list[Column]]) -> DataFrame:
    within = Window.partitionBy(group)
    name, keys = first
    rows = rows.withColumn(name, F.row_number().over(within.orderBy(*keys)) - 1)
    return rows.withColumns({n: F.row_number().over(within.orderBy(*k, name)) - 1 for n, k in others.items()})


def _in_ranges(rows: DataFrame, group: str, member: str, orders: dict[str, list[Column]]) -> DataFrame:
    """(group, member, a column for each order)."""
    places = None
    for i, (name, keys) in enumerate(orders.items()):
        sorted_ = rows.repartitionByRange(group, *keys).sortWithinPartitions(group, *keys)
        # The upper bits of the number are the range, the lower ones the position in it. The
        # table is written before it is counted: ranges drawn anew could be cut elsewhere.
        numbered = written(sorted_.select(group, member, F.monotonically_increasing_id().alias("_at")), f"places_{name}")
        numbered = numbered.withColumn("_range", F.shiftright("_at", 33))
        ranges = numbered.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        shifts = ranges.select(group, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
        placed = numbered.join(shifts, [group, "_range"]).select(group, member, F.lit(i).alias("_order"), (F.col("_at") + F.col("_shift")).cast("int").alias("_place"))
        places = placed if places is None else places.unionByName(placed)
    return places.groupBy(group, member).agg(*[F.max(F.when(F.col("_order") == i, F.col("_place"))).alias(n) for i, n in enumerate(orders)])


def places(rows: DataFrame, group: str, member: str, first: tuple[str, list[Column]], others: dict[str, list[Column]], most: int = HUB) -> DataFrame:
    """``rows`` with a column for each order: the row's place, from 0, within its ``group``.

    ``first`` is an order without ties, which also breaks the ties of ``others``; (group,
    member) tells rows apart. Rows of a null group count as one group, placed by a window."""
    large = written(hubs(rows, group, most), "hubs")
    if large.isEmpty():
        return _in_windows(rows, group, first, others)
    small = _in_windows(rows.join(large, group, "left_anti"), group, first, others)
    name, keys = first
    # Every order reads them twice, to draw its ranges and to sort.
    big = written(rows.join(large, group, "left_semi"), "hub_rows")
    orders = {name: keys} | {n: [*k, *keys] for n, k in others.items()}
    return small.unionByName(big.join(_in_ranges(big, group, member, orders), [group, member]))
