"""Repository scan: files are read, classified, hashed, and either kept or entered in the exclusion ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions import ids, languages, text
from quarry.sources import listing

# What a scan leaves out, and how generated files are told.
IGNORED_DIRECTORIES = [
    ".git", ".hg", ".svn", ".bzr", "node_modules", "bower_components", "jspm_packages", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    ".tox", ".venv", "venv", "env", ".env", "virtualenv", "site-packages", "dist-packages", "eggs", "dist", "build", "out", "target", "bin", "obj",
    ".idea", ".vscode", ".vs", ".settings", ".next", ".nuxt", ".svelte-kit", ".parcel-cache", ".turbo", ".gradle", ".m2", ".terraform", ".serverless",
    ".cache", "coverage", "htmlcov", ".nyc_output", "vendor", "third_party", "Pods", "DerivedData", ".dart_tool", ".pub-cache", ".quarry",
]
IGNORED_SUFFIXES = [
    ".lock", ".log", ".tmp", ".temp", ".bak", ".orig", ".rej", ".swp", ".pyc", ".pyo", ".pyd", ".class", ".o", ".obj", ".a", ".lib", ".so", ".dylib",
    ".dll", ".exe", ".wasm", ".jar", ".war", ".ear", ".nupkg", ".whl", ".egg", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".png", ".jpg",
    ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".pdf", ".psd", ".ai", ".eps", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".woff", ".woff2",
    ".ttf", ".otf", ".eot", ".db", ".sqlite", ".sqlite3", ".mdb", ".pdb", ".bin", ".dat", ".iso", ".dmg", ".pkl", ".npy", ".npz", ".parquet",
]
IGNORED_FILENAMES = [
    ".DS_Store", "Thumbs.db", "desktop.ini", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock", "Pipfile.lock",
    "Cargo.lock", "Gemfile.lock", "go.sum",
]
GENERATED_PATHS = [
    "/generated/", "/autogen/", "/auto-generated/", "/__generated__/", "/gen-code/", "/generated-sources/",
]
GENERATED_SUFFIXES = [
    "_pb2.py", "_pb2_grpc.py", ".pb.go", ".pb.cc", ".pb.h", ".g.cs", ".designer.cs", ".generated.cs", ".min.js", ".min.css", ".freezed.dart", ".g.dart",
    "_generated.go",
]
GENERATED_MARKERS = [
    "@generated", "DO NOT EDIT", "do not edit", "Code generated by", "code generated by", "automatically generated", "Auto-generated",
    "THIS FILE IS AUTO-GENERATED",
]
SNIFF_BYTES = 8192


@dataclass(frozen=True)
class ScanOptions:
    """What a scan leaves out; directories are compared without case."""

    directories: tuple[str, ...] = tuple(IGNORED_DIRECTORIES)
    suffixes: tuple[str, ...] = tuple(IGNORED_SUFFIXES)
    filenames: tuple[str, ...] = tuple(IGNORED_FILENAMES)
    detect_generated: bool = True
    detect_binary: bool = True
    markers: tuple[str, ...] = field(default=tuple(GENERATED_MARKERS))


def read_files(spark: SparkSession, root: str, options: ScanOptions | None = None) -> DataFrame:
    """path (relative to ``root``, POSIX), content, length of every file below ``root``.

    An ignored directory isn't opened: it is one row, whose path ends with a slash.  Files with an ignored name aren't
    read: their content is null, as that of files that can't be read.
    """
    options = options or ScanOptions()
    listed = listing.list_files(spark, root, options.directories)
    wanted = (F.col("kind") == "file") & ~is_ignored_name(F.col("path"), options)
    read = listing.with_content(listed.where(wanted).select("path", "length"), root)
    rest = listed.where(~wanted).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return read.unionByName(rest).select("path", "content", "length")


def pruned_directory(path: Column, options: ScanOptions) -> Column:
    """The shortest leading directory whose name is ignored; null if there is none."""
    parts = F.split(path, "/")
    names = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    known = F.array(*(F.lit(d.lower()) for d in options.directories))
    at = F.array_position(F.transform(names, lambda n: F.array_contains(known, F.lower(n))), True)
    return F.when(at > 0, F.array_join(F.slice(parts, 1, at.cast("int")), "/"))


def is_ignored_name(path: Column, options: ScanOptions) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    ends = "|".join(s.replace(".", r"\.") for s in options.suffixes)
    return name.isin(list(options.filenames)) | F.lower(name).rlike(f"(?:{ends})$")


def head(content: Column) -> Column:
    return F.substring(content, 1, SNIFF_BYTES)


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes (of a binary or string column)."""
    return F.contains(head(content.cast("binary")), F.lit(b"\x00"))


def looks_generated(path: Column, content: Column, options: ScanOptions) -> Column:
    """By a directory, by the end of the name, or by a marker in the head."""
    low, first = F.lower(path), head(content.cast("binary"))
    found = low.rlike("|".join(GENERATED_PATHS)) | low.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in GENERATED_SUFFIXES) + ")$")
    for m in options.markers:
        found = found | F.contains(first, F.lit(m.encode()))
    return found


def classify(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``files`` (path, content, length) with language, decision, parse_status and file_kind.

    ``decision`` is PRUNED, IGNORED, UNREADABLE, BINARY, GENERATED or KEPT; the order of the tests matters:
    names come before contents.  Null content is unreadable.  A kept file is SOURCE, or UNSUPPORTED if its
    language is unknown or no code; a kept source of size 0 is EMPTY, any other provisionally OK.
    """
    path, content = F.col("path"), F.col("content")
    binary = looks_binary(content) if options.detect_binary else F.lit(False)
    generated = looks_generated(path, content, options) if options.detect_generated else F.lit(False)
    decided = files.select("path", "content", "length", languages.detect(path).alias("language"), pruned_directory(path, options).alias("pruned")).withColumn(
        "decision",
        F.when(F.col("pruned").isNotNull(), "PRUNED").when(is_ignored_name(path, options), "IGNORED").when(content.isNull(), "UNREADABLE").when(binary, "BINARY").when(generated, "GENERATED").otherwise("KEPT"),
    )
    code = languages.is_code(F.col("language"))
    return decided.withColumn(
        "parse_status", F.when(F.col("decision") == "UNREADABLE", "FAILED").when(F.col("decision") != "KEPT", None).when(~code, "UNSUPPORTED").when(F.col("length") == 0, "EMPTY").otherwise("OK")
    ).withColumn("file_kind", F.when(F.col("decision") == "BINARY", "BINARY").when(F.col("decision") == "GENERATED", "GENERATED").when(F.col("decision").isin("PRUNED", "IGNORED"), "IGNORED").when(code, "SOURCE").otherwise("UNSUPPORTED"))


def measure(classified: DataFrame) -> DataFrame:
    """``classified`` with content_hash and line_count in place of the content."""
    return classified.withColumns({"content_hash": ids.content_hash(F.col("content").cast("binary")), "line_count": text.line_count(text.decoded("content"))}).drop("content")


def file_records(classified: DataFrame, model_version: Column | None = None) -> DataFrame:
    """The file table of the kept files, one row each; ``classified`` may be measured already."""
    if "content" in classified.columns:
        classified = measure(classified)
    kept = classified.where(F.col("decision").isin("KEPT", "UNREADABLE"))
    failed = F.col("decision") == "UNREADABLE"
    return kept.select(
        ids.file_id("path").alias("id"),
        "path",
        "language",
        F.when(failed, "").otherwise(F.col("content_hash")).alias("content_hash"),
        F.coalesce("length", F.lit(0)).cast("bigint").alias("size"),
        "parse_status",
        F.when(failed, "unreadable").alias("parse_error"),
        (model_version if model_version is not None else F.lit(None).cast("string")).alias("model_version"),
        "file_kind",
        F.lit(False).alias("is_binary"),
        F.lit(False).alias("is_generated"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.lit(0).alias("node_count"),
        F.lit(0).alias("max_depth"),
    )


def exclusion_ledger(classified: DataFrame) -> DataFrame:
    """path, reason, size of everything left out; a pruned directory is one entry, and ignored names have size 0."""
    files = classified.where(F.col("decision").isin("IGNORED", "BINARY", "GENERATED")).select("path", F.col("decision").alias("reason"), F.when(F.col("decision") == "IGNORED", 0).otherwise(F.col("length")).cast("bigint").alias("size"))
    pruned = classified.where("decision = 'PRUNED'").select(F.col("pruned").alias("path"), F.lit("IGNORED").alias("reason"), F.lit(0).cast("bigint").alias("size")).distinct()
    return files.unionByName(pruned)


def exclusion_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("reason").agg(F.count("*").alias("n"))


def language_histogram(files: DataFrame) -> DataFrame:
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
