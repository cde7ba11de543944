"""The versioned store: immutable version directories, and a journal of pointers whose newest names the active one.

A version is written completely, validated, and only then becomes visible by one new pointer file, which is
written beside its place and moved there.  Nothing is ever replaced, so this holds on local disks, HDFS and object
stores alike.  A failed run leaves the old version active; a rollback writes a pointer to an older version.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.ids import bag_digest
from quarry.functions.spans import SPAN
from quarry.sources.listing import filesystem

POINTERS = "_pointers"
# The columns of the persisted tables.
SCHEMAS = {
    "files": "id string, path string, language string, content_hash string, size bigint, parse_status string, parse_error string, model_version string, file_kind string, is_binary boolean, is_generated boolean, line_count int, node_count int, max_depth int",
    "symbols": f"id string, file_id string, name string, qualified_name string, symbol_type string, signature string, location {SPAN}, documentation string, content_hash string, model_version string, language string",
    "relationships": f"id string, source_symbol_id string, target_symbol_id string, relationship_type string, resolution_status string, confidence double, source_location {SPAN}, model_version string, target_name string",
    "evidence": "id string, entity_id string, file_id string, start_line int, end_line int, retrieval_source string, score double, model_version string",
    "chunks": "id string, symbol_id string, text string, chunk_type string, embedding_id string, token_count int, model_version string",
    "diagnostics": "severity string, code string, message string, file_path string, line int, recovery_action string",
    "excluded": "path string, reason string, size bigint",
}
#: What resolution needs of every file, and its results: kept, so that an incremental run parses nothing twice.
SCHEMAS |= {
    "calls": "path string, enclosing string, receiver string, callee string, call_id string",
    "imports": "path string, module string, name string",
    "bindings": "path string, enclosing string, name string, type_name string, scope string",
    "manifest": "path string, content_hash string, language string, size bigint",
    "resolutions": "call_id string, path string, target_id string, rung int, resolution_status string",
}
# The canonical order of each exported table.
ORDERS = {
    "files": ["path"],
    "symbols": ["qualified_name", "location.start_line", "id"],
    "relationships": ["relationship_type", "source_symbol_id", "coalesce(target_name, target_symbol_id)", "source_location.start_line", "source_location.start_col"],
    "evidence": ["entity_id", "start_line", "id"],
    "chunks": ["symbol_id", "chunk_type"],
    "diagnostics": ["coalesce(file_path, '')", "code", "coalesce(line, 0)"],
    "excluded": ["path"],
    "calls": ["path", "call_id"],
    "imports": ["path", "module", "name"],
    "bindings": ["path", "coalesce(enclosing, '')", "scope", "name"],
    "manifest": ["path"],
    "resolutions": ["path", "call_id"],
}


def atomic_write(path: Path, data: str) -> None:
    """Write a file completely or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def canonical_json(payload) -> str:
    """Sorted keys, two spaces of indentation, no ASCII escapes."""
    return json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False)


class Store:
    """Versions below one directory: a path, or the URI of a file system that all machines share."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.files, self.base = filesystem(self.root)

    def path(self, version: str, table: str) -> str:
        return f"{self.root}/versions/{version}/{table}"

    def _is_directory(self, path: str) -> bool:
        return self.files.get_file_info(path).type == fs.FileType.Directory

    def _pointers(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/{POINTERS}", allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".json"))

    def active(self) -> str | None:
        """The active version; None if there is none or the newest pointer can't be read."""
        try:
            with self.files.open_input_stream(self._pointers()[-1]) as f:
                return json.loads(f.read())["model_version"]
        except (OSError, ValueError, KeyError, TypeError, IndexError):
            return None

    def versions(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/versions", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def read(self, spark: SparkSession, table: str, version: str | None = None) -> DataFrame | None:
        """A table of a version (the active one by default); None if it is missing or has other columns."""
        version = version or self.active()
        if not version or not self._is_directory(f"{self.base}/versions/{version}/{table}"):
            return None
        found = spark.read.parquet(self.path(version, table))
        names = column_names(table)
        return found.select(*names) if set(names) <= set(found.columns) else None

    def write(self, version: str, tables: dict[str, DataFrame]) -> None:
        """Write a version's tables; a table that is complete is left as it is."""
        for name, df in tables.items():
            done = f"{self.base}/versions/{version}/{name}/_SUCCESS"
            if self.files.get_file_info(done).type == fs.FileType.NotFound:
                df.select(*column_names(name)).write.mode("overwrite").parquet(self.path(version, name))

    def publish(self, version: str, taken_at: str | None = None) -> None:
        folder = f"{self.base}/{POINTERS}"
        self.files.create_dir(folder, recursive=True)
        number = len(self._pointers()) + 1
        beside = f"{folder}/{uuid.uuid4().hex}.tmp"
        with self.files.open_output_stream(beside) as f:
            f.write(canonical_json({"model_version": version, "taken_at": taken_at}).encode())
        self.files.move(beside, f"{folder}/{number:012d}.json")

    def rollback(self, version: str) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self.publish(version)


def column_names(table: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in _split(SCHEMAS[table])]


def _split(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def manifest(files: DataFrame) -> DataFrame:
    """path, content_hash, language, size of each file."""
    return files.select("path", "content_hash", "language", "size")


def table_digest(df: DataFrame) -> DataFrame:
    """digest: of a table's rows in any order; repeated rows count.  Each row is hashed as JSON with its columns in
    alphabetical order and nulls spelled out."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return df.select(h.alias("h")).agg(bag_digest("h").alias("digest"))


def export_json(df: DataFrame, table: str, path: str) -> None:
    """One table as canonical JSON in canonical order: for small models, since the driver writes it."""
    rows = [json.loads(r[0]) for r in df.orderBy(*map(F.expr, ORDERS[table])).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    atomic_write(Path(path), canonical_json(rows))
