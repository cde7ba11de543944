"""Questions: intent by rules, and deterministic answers with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators import graph, search

# Intents and the patterns that speak for them.
INTENTS = {
    "FIND_CALLERS": r"who calls|callers? of|what calls|used by|where is .* used",
    "FIND_CALLEES": r"what does .* call|callees? of|calls made by",
    "DEPENDENCIES": r"depend(s|encies)? (on|of)|imports? of|what does .* (import|need)",
    "IMPACT": r"impact|what breaks|affected|what happens if",
    "TRACE": r"trace|path from|how does .* reach|flow from",
    "DEFINITION": r"where is .* defined|definition of|show me|find (the )?(class|function|method|symbol)",
    "EXPLAIN": r"explain|what is|how does .* work|why",
}


def classify_intent(question: Column) -> Column:
    """struct<intent, confidence>: the only matching intent (1.0), the first of several (1 / how many, and
    AMBIGUOUS if they are more than two), or UNKNOWN (0.0)."""
    low = F.lower(question)
    hits = F.filter(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in INTENTS.items())), lambda x: x.isNotNull())
    n = F.size(hits)
    intent = F.when(n == 0, "UNKNOWN").when(n > 2, "AMBIGUOUS").otherwise(F.try_element_at(hits, F.lit(1)))
    return F.struct(F.coalesce(intent, F.lit("UNKNOWN")).alias("intent"), F.when(n > 0, F.round(1.0 / n, 6)).otherwise(0.0).alias("confidence"))


def answer(intent: str, name: str, symbols: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """node, via, distance of the answer; an empty table means "not found".  ``edges``: source, target ids."""
    named = symbols.where((F.lower("name") == name.lower()) | (F.lower("qualified_name") == name.lower())).select(F.col("id").alias("node")).distinct()
    if intent == "FIND_CALLERS":
        return graph.callers(edges, named).select(F.col("source").alias("node"), F.col("target").alias("via"), F.lit(1).alias("distance"))
    if intent in ("FIND_CALLEES", "DEPENDENCIES"):
        return graph.callees(edges, named).select(F.col("target").alias("node"), F.col("source").alias("via"), F.lit(1).alias("distance"))
    if intent == "IMPACT":
        return graph.impacted(edges, named, hops).where("distance > 0").select("node", F.col("seed").alias("via"), "distance")
    return named.select("node", F.col("node").alias("via"), F.lit(0).alias("distance"))


class Tools:
    """The operations offered to a caller, with errors as values: {"error": ...} instead of an exception."""

    def __init__(self, files: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame):
        self.files, self.symbols, self.chunks, self.edges = files, symbols, chunks, edges

    def search_symbol(self, needle: str, k: int = 10) -> DataFrame | dict:
        return search.search_symbols(self.symbols, needle, k) if needle.strip() else {"error": "empty needle"}

    def search_code(self, words: str, k: int = 10) -> DataFrame | dict:
        query = [w for w in words.lower().split() if w]
        return search.bm25(self.chunks.select("id", "text"), query, k) if query else {"error": "empty query"}

    def find_callers(self, name: str) -> DataFrame:
        return answer("FIND_CALLERS", name, self.symbols, self.edges)

    def find_callees(self, name: str) -> DataFrame:
        return answer("FIND_CALLEES", name, self.symbols, self.edges)

    def trace_dependencies(self, name: str, hops: int = 5) -> DataFrame | dict:
        return answer("IMPACT", name, self.symbols, self.edges, hops) if hops > 0 else {"error": "hops must be positive"}

    def get_file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path).limit(1)
