"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): every round is two aggregations by node, each combined map-side, and the
edges are written to the shared folder between rounds. Nothing is collected but a row count
and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import written


def _star(edges: DataFrame) -> DataFrame:
    """Join every (u, v) with the least node next to u, u included.

    The least nodes are written, so that both sides of the join come as they are dealt: a star's many edges at one
    centre are then split over tasks.
    """
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger, smaller)."""
    starred = _star(edges)
    pairs = starred.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                             F.struct("u", F.col("m").alias("v")))).alias("e"))
    return pairs.select("e.u", "e.v").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long); the component is its least node.

    Nodes without an edge to another node are not listed. Repeated edges, loops and nulls are
    dropped first. Rounds end when the edges no longer change, which they do after a number of rounds that grows with
    the logarithm of the longest path.
    """
    state = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = written(_small_star(_large_star(state)), "edges")
        row = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (row.n, row.s):
            return state.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = (row.n, row.s)
