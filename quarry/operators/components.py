"""Connected components of an edge list by alternating large-star and small-star steps.

Every round shuffles the edges on one endpoint and hooks them to the smallest neighbour; a hub's
neighbours are never collected, only its minimum (a map-side combined aggregate) is joined back.  The
number of rounds grows with the logarithm of the longest chain.  Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.sources.tables import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hooked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component of every node that occurs in an edge (a, b); component is its smallest node.

    Loops, repeated edges and either direction are allowed; edges with a null end are ignored.  An empty
    list gives an empty table.
    """
    nodes = edges.where("a is not null and b is not null").select("a", "b").distinct()
    ends = nodes.select(F.col("a").alias("node")).unionByName(nodes.select(F.col("b").alias("node"))).distinct()
    now = cut(nodes.where("a <> b"))
    before = None
    for _ in range(rounds):
        now = cut(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return ends.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
