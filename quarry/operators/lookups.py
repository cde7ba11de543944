"""Filters and point lookups of the model; ids and paths reach the Parquet scan as pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions import ids

DEGRADED = ["PARTIAL", "FAILED"]


def source_files(files: DataFrame) -> DataFrame:
    return files.where("file_kind = 'SOURCE'")


def degraded_files(files: DataFrame) -> DataFrame:
    """Files of which only part, or nothing, was understood."""
    return files.where(F.col("parse_status").isin(DEGRADED))


def symbol_by_id(symbols: DataFrame, symbol_id: str) -> DataFrame:
    """At most one row."""
    return symbols.where(F.col("id") == symbol_id).limit(1)


def symbols_by_name(symbols: DataFrame, qualified_name: str) -> DataFrame:
    return symbols.where(F.col("qualified_name") == qualified_name)


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    """At most one row."""
    return files.where(F.col("path") == path).limit(1)


def relationships_from(relationships: DataFrame, symbol_id: str) -> DataFrame:
    return relationships.where(F.col("source_symbol_id") == symbol_id)


def relationships_to(relationships: DataFrame, symbol_id: str) -> DataFrame:
    return relationships.where(F.col("target_symbol_id") == symbol_id)


def unresolved(relationships: DataFrame) -> DataFrame:
    return relationships.where(ids.is_unresolved("target_symbol_id"))


def evidence_of(evidence: DataFrame, entity_id: str) -> DataFrame:
    return evidence.where(F.col("entity_id") == entity_id)
