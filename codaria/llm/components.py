"""Connected components of an edge table, by alternating large and small stars.

Every step is an aggregation to each node's least neighbour, pre-aggregated
map-side, and an equi-join back, which adaptive execution can split at a node with
very many edges. (Broadcasting such nodes, as skew.py does, makes each round's plan
four times as large, which the driver pays for in memory.) Nothing is collected to
the driver but one number a round. A round is checkpointed, so executors may be
lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codaria.llm.storage import cut

#: Edges that one task of a round begins with, at least.
EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v, distinct. Returns the same form."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Nodes of undirected edges (a, b) with the least node each one reaches: (node, component).

    Self-loops and repeated edges are fine; an edge with a null end is ignored;
    an empty table gives an empty one. Raises if max_rounds do not suffice
    (rounds grow with the logarithm of the number of nodes).
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    for _ in range(max_rounds):
        if sign:  # as many files as the edges are worth
            edges = edges.coalesce(max(8, sign[0] // EDGES))
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        sign = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
