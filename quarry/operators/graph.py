"""Graph queries over edge lists: neighbours, bounded traversal, cycles, impact, and shortest paths.

Traversal is semi-naive: each hop joins only the frontier with the edges and drops what was seen by an
anti-join; reliable checkpoints cut the lineage of long runs.  Nothing is collected but one count a hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.sources.tables import cut


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target of the edges into ``targets`` (node), each once."""
    return edges.select("source", "target").join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("source", "target").distinct()


def callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, target of the edges out of ``sources`` (node), each once."""
    return edges.select("source", "target").join(sources.select(F.col("node").alias("source")).distinct(), "source", "left_semi").select("source", "target").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, hops: int, cut_every: int = 3) -> DataFrame:
    """seed, node, distance: every node within ``hops`` edges of a seed, with the least distance.

    The seed itself is at distance 0.  Cycles end the traversal by themselves, since seen pairs don't
    come back.  Null ends are ignored.
    """
    links = edges.where("source is not null and target is not null").select(F.col("source").alias("node"), "target").distinct()
    seen = seeds.where("node is not null").select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for k in range(1, hops + 1):
        step = frontier.join(links, "node").select("seed", F.col("target").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(k))
        if k % cut_every == 0 and k < hops:
            step = cut(step)
            if step.isEmpty():
                break
            seen = cut(seen.unionByName(step))
        else:
            seen = seen.unionByName(step)
        frontier = step
    return seen


def impacted(edges: DataFrame, changed: DataFrame, hops: int) -> DataFrame:
    """seed, node, distance: what depends on the changed nodes, directly or over others."""
    return reachable(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), changed, hops)


def cyclic_nodes(edges: DataFrame, hops: int) -> DataFrame:
    """node, length of the shortest cycle through it, if it has at most ``hops`` edges.

    Nodes without a way in or out are peeled off first, so that only the core is traversed."""
    core = edges.where("source is not null and target is not null").select("source", "target").distinct()
    for _ in range(3):
        core = core.join(core.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
    core = cut(core)
    seeds = core.select(F.col("source").alias("node")).distinct()
    out = reachable(core, seeds, hops - 1)
    back = out.join(core.select(F.col("source").alias("node"), F.col("target").alias("seed")), ["seed", "node"])
    return back.groupBy(F.col("seed").alias("node")).agg((F.min("distance") + 1).alias("length"))


def trace_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, hops: int) -> DataFrame:
    """source, target, path (array of nodes), hops: one shortest path from each start to each goal it reaches
    within ``hops`` edges; of equally short ones the first in the order of their nodes."""
    links = edges.where("source is not null and target is not null").select(F.col("source").alias("node"), "target").distinct()
    best = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    frontier = best
    for _ in range(hops):
        step = frontier.join(links, "node").select("start", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        fresh = step.join(best.select("start", "node"), ["start", "node"], "left_anti")
        frontier = fresh.groupBy("start", "node").agg(F.min("path").alias("path"))
        best = best.unionByName(frontier)
    found = best.join(goals.select("node").distinct(), "node", "left_semi")
    return found.select(F.col("start").alias("source"), F.col("node").alias("target"), "path", (F.size("path") - 1).alias("hops"))


def path_evidence(paths: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """start, goal, hop (from 1), source, target, edge_id, evidence_id of each hop of ``paths`` (as ``trace_paths``): the
    first of the hop's edges (id, source, target) and the first of its evidence (entity_id, evidence_id); null if there
    is none."""
    pairs = F.transform(F.sequence(F.lit(1), F.col("hops")), lambda i: F.struct(i.alias("hop"), F.get("path", i - 1).alias("source"), F.get("path", i).alias("target")))
    hops = paths.where("hops > 0").select(F.col("source").alias("start"), F.col("target").alias("goal"), F.explode(pairs).alias("h")).select("start", "goal", "h.*")
    edge = edges.groupBy("source", "target").agg(F.min("id").alias("edge_id"))
    shown = evidence.groupBy(F.col("entity_id").alias("edge_id")).agg(F.min("evidence_id").alias("evidence_id"))
    return hops.join(edge, ["source", "target"], "left").join(shown, "edge_id", "left").select("start", "goal", "hop", "source", "target", "edge_id", "evidence_id")
