"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import dropped, written


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step.

    Least neighbours are written before they are joined: then the join shuffles both sides, and
    adaptive execution can split the many larger neighbours of a hub. Smaller neighbours are few:
    those that the large star leaves a node are the smallest nodes of its neighbours' neighbourhoods.
    """
    # Each node's larger neighbours are linked with the smallest node of its neighbourhood.
    both = edges.union(edges.select("b", "a"))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
    # Each node and its smaller neighbours are linked with the smallest of them.
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.union(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
    dropped(least, large)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: longs) other than the components' smallest.

    Edges are never gathered by component: a step keeps at most one edge for each node and
    neighbour, and what each step leaves is written to the shared folder, where only the last one
    stays. It ends when a whole round changes nothing, after about log^2 of the longest path in the
    worst case.
    """
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._scratch = now._scratch
            return out
        before, last = state, now
        now = _step(last)
        dropped(last)
