"""Validation: every broken rule is a row (entity_kind, entity_id, rule); nothing is raised.

Rules are one array expression per table, so a table is read once; references are anti-joins, duplicates
a map-side combined count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import ids, spans


def _broken(df: DataFrame, kind: str, id_col: str, rules: dict[str, Column]) -> DataFrame:
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return df.select(F.lit(kind).alias("entity_kind"), F.col(id_col).alias("entity_id"), F.explode(hits).alias("rule"))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def file_problems(files: DataFrame) -> DataFrame:
    p = F.col("path")
    rules = {
        "file.path.missing": _empty("path"),
        "file.path.absolute": p.startswith("/") | p.startswith("\\") | F.contains(p, F.lit(":")),
        "file.path.backslash": F.contains(p, F.lit("\\")),
        "file.hash.missing": _empty("content_hash"),
        "file.size.negative": F.col("size") < 0,
        "version.missing": _empty("model_version"),
        "file.failure.unexplained": (F.col("parse_status") == "FAILED") & _empty("parse_error"),
        "file.source.no_language": (F.col("file_kind") == "SOURCE") & F.col("language").isNull(),
    }
    return _broken(files, "file", "id", rules)


def symbol_problems(symbols: DataFrame) -> DataFrame:
    rules = {
        "symbol.name.missing": _empty("name"),
        "symbol.qualified_name.missing": _empty("qualified_name"),
        "symbol.qualified_name.no_module": (F.col("symbol_type") != "MODULE") & ~F.contains(F.col("qualified_name"), F.lit(":")),
        "file_id.missing": _empty("file_id"),
        "version.missing": _empty("model_version"),
        **{f"span.{k}": v for k, v in spans.rules(F.col("location")).items()},
    }
    return _broken(symbols, "symbol", "id", rules)


def relationship_problems(relationships: DataFrame) -> DataFrame:
    c = F.col("confidence")
    rules = {
        "relationship.source.missing": _empty("source_symbol_id"),
        "relationship.target.missing": _empty("target_symbol_id"),
        "relationship.confidence.range": ~c.between(0.0, 1.0),
        "relationship.exact.unsure": (F.col("resolution_status") == "RESOLVED_EXACT") & (c < 1.0),
        "relationship.unresolved.sure": (F.col("resolution_status") == "UNRESOLVED") & (c > 0.0),
        "relationship.unresolved.nameless": ids.is_unresolved("target_symbol_id") & _empty("target_name"),
        "version.missing": _empty("model_version"),
        **{f"span.{k}": v for k, v in spans.rules(F.col("source_location")).items()},
    }
    return _broken(relationships, "relationship", "id", rules)


def evidence_problems(evidence: DataFrame) -> DataFrame:
    rules = {
        "evidence.entity.missing": _empty("entity_id"),
        "file_id.missing": _empty("file_id"),
        "evidence.lines.start": F.col("start_line") < 1,
        "evidence.lines.order": F.col("end_line") < F.col("start_line"),
        "evidence.score.range": ~F.col("score").between(0.0, 1.0),
        "version.missing": _empty("model_version"),
    }
    return _broken(evidence, "evidence", "id", rules)


def chunk_problems(chunks: DataFrame) -> DataFrame:
    rules = {"chunk.symbol.missing": _empty("symbol_id"), "chunk.text.missing": _empty("text"), "chunk.type.missing": _empty("chunk_type"), "chunk.tokens.negative": F.col("token_count") < 0, "version.missing": _empty("model_version")}
    return _broken(chunks, "chunk", "id", rules)


def dangling(rows: DataFrame, kind: str, id_col: str, reference: str, targets: DataFrame, target_col: str = "id") -> DataFrame:
    """Rows whose ``reference`` isn't among ``targets``; null references are another rule's business."""
    known = targets.select(F.col(target_col).alias(reference)).distinct()
    return rows.where(F.col(reference).isNotNull()).join(known, reference, "left_anti").select(F.lit(kind).alias("entity_kind"), F.col(id_col).alias("entity_id"), F.lit(f"dangling.{reference}").alias("rule"))


def duplicates(rows: DataFrame, kind: str, id_col: str = "id") -> DataFrame:
    return rows.groupBy(F.col(id_col).alias("entity_id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(kind).alias("entity_kind"), "entity_id", F.lit("id.repeated").alias("rule"))


def model_problems(files: DataFrame, symbols: DataFrame, relationships: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Everything wrong with a model: rules, references, duplicates, and versions that differ from the files'."""
    parts = [
        file_problems(files), symbol_problems(symbols), relationship_problems(relationships), evidence_problems(evidence), chunk_problems(chunks),
        dangling(symbols, "symbol", "id", "file_id", files),
        dangling(relationships, "relationship", "id", "source_symbol_id", symbols),
        dangling(relationships.where(~ids.is_unresolved("target_symbol_id")), "relationship", "id", "target_symbol_id", symbols),
        dangling(evidence, "evidence", "id", "file_id", files),
        dangling(evidence, "evidence", "id", "entity_id", symbols),
        dangling(chunks, "chunk", "id", "symbol_id", symbols),
        *(duplicates(df, kind) for df, kind in ((files, "file"), (symbols, "symbol"), (relationships, "relationship"), (evidence, "evidence"), (chunks, "chunk"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def valid_and_rejected(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols without broken rules, and one diagnostic per broken rule of the others."""
    broken = symbol_problems(symbols)
    good = symbols.join(broken.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti")
    return good, broken.select(F.lit("ERROR").alias("severity"), F.lit("ir.invalid_symbol").alias("code"), F.concat(F.lit("symbol "), "entity_id", F.lit(" rejected: "), "rule").alias("message"))


def claim_verdicts(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """answer_id, claims, grounded, verdict, score: an answer's claimed edges (answer_id, source, kind, target) held
    against the model's.  PASS if all are there, FAIL if some aren't, INSUFFICIENT if it claims nothing
    (a row with a null source)."""
    known = edges.select("source", "kind", "target").distinct().withColumn("known", F.lit(1))
    checked = claims.join(known, ["source", "kind", "target"], "left")
    n, ok = F.count("source"), F.count(F.when(F.col("source").isNotNull(), F.col("known")))
    return checked.groupBy("answer_id").agg(n.alias("claims"), ok.alias("grounded")).select("answer_id", "claims", "grounded", F.when(F.col("claims") == 0, "INSUFFICIENT").when(F.col("claims") == F.col("grounded"), "PASS").otherwise("FAIL").alias("verdict"), F.when(F.col("claims") > 0, F.round(F.col("grounded") / F.col("claims"), 6)).alias("score"))
