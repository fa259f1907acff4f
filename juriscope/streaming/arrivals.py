"""Edges that arrive as a stream: keeps valid edges and recomputes what they touch.

An extension; a batch of edges is joined, validated and merged by its key, and the
statuses of the opinions it cites are the only ones written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from juriscope.operators import edges, later_courts


def follow(stream: DataFrame, opinions: DataFrame, courts: DataFrame, read_edges: Callable[[], DataFrame], write_edges: Callable[[DataFrame], None], write_statuses: Callable[[DataFrame], None], checkpoint: str):
    """Starts the query. ``read_edges`` gives all edges, those just written included."""

    def batch(new: DataFrame, _: int) -> None:
        known = read_edges().select("citing", "cited", "treatment")
        write_edges(new.dropDuplicates(["citing", "cited", "treatment"]).join(known, ["citing", "cited", "treatment"], "left_anti"))
        touched = new.select("cited").distinct()
        views = edges.valid(edges.joined(read_edges().join(touched, "cited", "left_semi"), opinions, courts))
        mine = opinions.join(touched.withColumnRenamed("cited", "cluster_id"), "cluster_id", "left_semi")
        write_statuses(later_courts.statuses(later_courts.rows(views), mine, courts))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
