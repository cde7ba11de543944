"""Hybrid retrieval: full text, vectors and graph are ranked apart, fused, expanded, deduplicated and cut to a budget."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from quarry.operators import search


def expanded(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """id, position of the neighbours of ranked ``seeds`` (id, position), both ways, ranked by their best seed and id."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source is not null and target is not null")
    near = both.join(seeds.select(F.col("id").alias("source"), F.col("position").alias("p")), "source")
    best = near.groupBy(F.col("target").alias("id")).agg(F.min("p").alias("p")).join(seeds.select("id"), "id", "left_anti")
    return best.select("id", F.row_number().over(W.orderBy("p", "id")).alias("position"))  # neighbours of a top-k


def hybrid(rankings: list[DataFrame], edges: DataFrame, texts: DataFrame, k: int, budget: int) -> DataFrame:
    """id, score, position, tokens, running: the context of a question, best first.

    ``rankings`` (id, position) come from full text and vectors.  Their fusion gives ``k`` seeds, whose neighbours in
    ``edges`` (source, target) are a ranking of their own; all are fused again.  Of equal texts (id, text) the best one
    stays, and what follows beyond ``budget`` tokens is left out.  An id without a text has none to give and is left out.
    """
    seeds = search.fuse(rankings, k)
    fused = search.fuse([*rankings, expanded(seeds, edges)], 4 * k).drop("position")
    known = texts.where("text is not null").select("id", F.sha2("text", 256).alias("digest"), F.floor(F.length("text") / 4).alias("tokens"))
    held = fused.join(known, "id")
    first = W.partitionBy("digest").orderBy(F.desc("score"), "id")
    once = held.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy", "digest")
    order = W.orderBy(F.desc("score"), "id")  # rows of a top-k
    ranked = once.withColumn("position", F.row_number().over(order)).withColumn("running", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.where(F.col("running") <= budget).select("id", "score", "position", "tokens", "running")


#: What a word of a question may be.
_WORD = re.compile(r"[A-Za-z0-9_]+")


def context(question: str, symbols: DataFrame, chunks: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, query: DataFrame | None = None, k: int = 20, budget: int = 4000) -> DataFrame:
    """The context of a question about a model, as ``hybrid``: id (of chunks), score, position, tokens, running.

    The plan: full text over the chunks, the chunks of symbols whose names stand in the question, and of ``vectors``
    (vec_id: the chunk, embedding) those nearest to ``query`` if given; expanded over the edges (source, target symbols)
    of the chunks' symbols.  A question without words gives an empty table.
    """
    words = _WORD.findall(question.lower())
    texts = chunks.select("id", "text")
    rankings = [search.bm25(texts, words, 4 * k).select("id", "position")] if words else []
    named = symbols.where(F.lower("name").isin(words)).select(F.col("id").alias("symbol_id")).distinct()
    own = chunks.join(named, "symbol_id").orderBy("id").limit(4 * k).select("id")
    rankings.append(own.select("id", F.row_number().over(W.orderBy("id")).alias("position")))  # rows of a top-k
    if vectors is not None and query is not None:
        near = search.nearest(vectors, query, 4 * k)
        rankings.append(near.select(F.col("vec_id").alias("id"), "position"))
    of = chunks.select("id", "symbol_id")
    links = edges.join(of.select(F.col("id").alias("a"), F.col("symbol_id").alias("source")), "source").join(of.select(F.col("id").alias("b"), F.col("symbol_id").alias("target")), "target").select(F.col("a").alias("source"), F.col("b").alias("target"))
    return hybrid(rankings, links, texts, k, budget)
