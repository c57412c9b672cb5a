"""Connected components of an edge table by alternating large and small stars.

Each round keeps the components and shortens paths, until every node is linked to the smallest node it reaches.
Both stars need the minimum of a node's neighbours only, so neighbours are aggregated, never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenflow.llm.common import forget, settle


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node ``a`` to its smaller node ``b``; loops and nulls go."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest among the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for each node of ``edges`` (columns ``a`` and ``b``, long): component is its smallest node.

    Loops, repeated edges and edges with a null end change nothing; no edges give no rows. The loop ends when a round
    changes nothing, which the method reaches after a number of rounds that grows with the logarithm of the nodes.
    """
    now = settle(_ordered(edges), "edges")
    mark = _mark(now)
    for _ in range(rounds if mark[0] else 0):
        after = settle(_ordered(_small_star(_ordered(_large_star(now)))), "edges")
        forget(now)
        now, old, mark = after, mark, _mark(after)
        if mark == old:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
