"""Facts become the model: symbols, relationships, evidence, chunks and diagnostics, all by joins and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import ids, spans, text

# How evidence is named, and its score.
SOURCE, SCORE = "offline.ast", 1.0


def overload_names(symbols: DataFrame, *key: str) -> DataFrame:
    """``symbols`` with ``id_name``: the qualified name, and for all members of a group of equal (key, type,
    qualified name) a suffix from the signature."""
    n = F.count("*").over(W.partitionBy(*key, "symbol_type", "qualified_name"))
    suffix = F.concat(F.lit("#"), F.substring(F.sha1(F.coalesce("signature", F.lit(""))), 1, 6))
    return symbols.withColumn("group_size", n).withColumn("id_name", F.when(F.col("group_size") > 1, F.concat("qualified_name", suffix)).otherwise(F.col("qualified_name")))


def ordinal_suffix(rows: DataFrame, id_col: str, *order: str) -> DataFrame:
    """Repeated ids get ``~1``, ``~2`` ... in order; the first keeps the bare id."""
    k = F.row_number().over(W.partitionBy(id_col).orderBy(*order)) - 1
    return rows.withColumn("_k", k).withColumn(id_col, F.when(F.col("_k") > 0, F.concat(id_col, F.lit("~"), F.col("_k").cast("string"))).otherwise(F.col(id_col))).drop("_k")


def symbol_ids(parsed: DataFrame) -> DataFrame:
    """The symbols of all files with their ids: what relationships need.  Nothing of the texts is read."""
    facts = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    named = overload_names(facts, "path").withColumn("id", ids.symbol_id("path", "symbol_type", "id_name"))
    return ordinal_suffix(named, "id", "ordinal").withColumnRenamed("span", "location")


def symbol_table(parsed: DataFrame, files: DataFrame, version: Column) -> DataFrame:
    """The symbols of all files, with the columns of the model and ``path``, ``parent``, ``ordinal``, ``group_size``,
    ``slice``.  ``parsed`` has slices; ``files`` has path, id and language."""
    known = files.select("path", F.col("id").alias("file_id"), "language")
    return symbol_ids(parsed).join(known, "path").select(
        "id", "file_id", "name", "qualified_name", "symbol_type", "signature", "location", "documentation",
        text.hash_text("slice").alias("content_hash"), version.alias("model_version"), "language", "path", "parent", "ordinal", "group_size", "slice",
    )


def evidence_table(symbols: DataFrame) -> DataFrame:
    """Exactly one row per symbol."""
    start, end = F.col("location.start_line"), F.col("location.end_line")
    return symbols.select(ids.evidence_id("id", "file_id", start, end, F.lit(SOURCE)).alias("id"), F.col("id").alias("entity_id"), "file_id", start.alias("start_line"), end.alias("end_line"), F.lit(SOURCE).alias("retrieval_source"), F.lit(SCORE).alias("score"), "model_version")


def _owners(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, qualified name) -> first symbol, and path -> module symbol."""
    first = symbols.groupBy("path", F.col("qualified_name").alias("owner")).agg(F.min_by("id", "ordinal").alias("owner_id"))
    module = symbols.where("ordinal = 0").select("path", F.col("id").alias("module_id"))
    return first, module


def relationship_table(parsed: DataFrame, symbols: DataFrame, version: Column) -> DataFrame:
    """CONTAINS (child to parent, exact), IMPORTS, INHERITS and CALLS (unresolved, confidence 0)."""
    first, module = _owners(symbols)
    up = symbols.where("parent is not null").join(first.withColumnRenamed("owner", "parent"), ["path", "parent"])
    contains = up.where("id <> owner_id").select("path", F.col("id").alias("source_symbol_id"), F.col("owner_id").alias("target_symbol_id"), F.lit("CONTAINS").alias("relationship_type"), F.col("location").alias("source_location"), F.col("parent").alias("target_name"))

    def edges(column: str, kind: str, prefix: str, name: Column) -> DataFrame:
        rows = parsed.select("path", F.explode(column).alias("f")).select("path", F.col("f.enclosing").alias("owner"), F.col("f.span").alias("source_location"), name.alias("target_name"))
        owned = rows.join(first, ["path", "owner"], "left").join(module, "path")
        return owned.select("path", F.coalesce("owner_id", "module_id").alias("source_symbol_id"), ids.unresolved_target(prefix, F.col("target_name")).alias("target_symbol_id"), F.lit(kind).alias("relationship_type"), "source_location", "target_name")

    loose = edges("imports", "IMPORTS", "module", F.col("f.module")).unionByName(edges("inherits", "INHERITS", "type", F.col("f.base"))).unionByName(edges("calls", "CALLS", "call", F.concat_ws(".", "f.receiver", "f.callee")))
    every = contains.unionByName(loose)
    exact = F.col("relationship_type") == "CONTAINS"
    rid = ids.relationship_id("source_symbol_id", "relationship_type", F.coalesce("target_name", "target_symbol_id"), F.col("source_location.start_line"), F.col("source_location.start_col"))
    return every.select(rid.alias("id"), "source_symbol_id", "target_symbol_id", "relationship_type", F.when(exact, "RESOLVED_EXACT").otherwise("UNRESOLVED").alias("resolution_status"), F.when(exact, 1.0).otherwise(0.0).alias("confidence"), "source_location", version.alias("model_version"), "target_name", "path")


def import_lines(imports: Column) -> Column:
    """``module (a, b)`` of each import, joined by line feeds; ``(no imports)`` if there are none."""
    one = lambda f: F.concat(f["module"], F.when(F.size(f["names"]) > 0, F.concat(F.lit(" ("), F.array_join(f["names"], ", "), F.lit(")"))).otherwise(""))
    return F.when(F.size(imports) > 0, F.array_join(F.transform(imports, one), "\n")).otherwise("(no imports)")


def chunk_table(parsed: DataFrame, symbols: DataFrame, version: Column) -> DataFrame:
    """One chunk per symbol with text, an imports chunk per file, and a parse_error chunk per degraded file."""
    module = symbols.where("ordinal = 0").select("path", F.col("id").alias("symbol_id"))
    own = symbols.where("slice <> ''").select(F.col("id").alias("symbol_id"), F.col("slice").alias("text"), F.lower("symbol_type").alias("chunk_type"), "path")
    imported = parsed.select("path", import_lines(F.col("imports")).alias("text")).join(module, "path").select("symbol_id", "text", F.lit("imports").alias("chunk_type"), "path")
    said = F.array_join(F.transform("diagnostics", lambda d: F.concat(d["code"], F.lit(": "), d["message"])), "\n")
    failed = parsed.where("parse_status in ('PARTIAL', 'FAILED')").select("path", F.coalesce(F.nullif(said, F.lit("")), "parse_error", F.lit("parse failed")).alias("text")).join(module, "path").select("symbol_id", "text", F.lit("parse_error").alias("chunk_type"), "path")
    every = own.unionByName(imported).unionByName(failed)
    return every.select(ids.chunk_id("symbol_id", "chunk_type").alias("id"), "symbol_id", "text", "chunk_type", F.lit(None).cast("string").alias("embedding_id"), text.estimate_tokens("text").alias("token_count"), version.alias("model_version"), "path")


def diagnostic_table(parsed: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """severity, code, message, file_path, line, recovery_action; with ``symbols`` also one per overload group."""
    said = parsed.select("path", F.explode("diagnostics").alias("d")).select("d.severity", "d.code", "d.message", F.col("path").alias("file_path"), "d.line", F.col("d.recovery").alias("recovery_action"))
    if symbols is None:
        return said
    groups = symbols.where("group_size > 1").groupBy("path", "symbol_type", "qualified_name").agg(F.count("*").alias("n"), F.min("location.start_line").alias("line"))
    return said.unionByName(groups.select(F.lit("INFO").alias("severity"), F.lit("ir.overload").alias("code"), F.format_string("%s stands for %d declarations, told apart by their signatures", "qualified_name", "n").alias("message"), F.col("path").alias("file_path"), "line", F.lit("none").alias("recovery_action")))


def counts(files: DataFrame, symbols: DataFrame, relationships: DataFrame, evidence: DataFrame, chunks: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """entity, n of every table, and the number of degraded files."""
    tables = {"files": files, "symbols": symbols, "relationships": relationships, "evidence": evidence, "chunks": chunks, "diagnostics": diagnostics, "degraded_files": files.where("parse_status in ('PARTIAL', 'FAILED')")}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out
