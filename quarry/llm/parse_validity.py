"""Source files that do not parse.

Every file is judged by a parser of its language (``syntax``): statements by recursive descent,
expressions by precedence climbing, and panic-mode recovery, so that one pass finds all faults of a
file.  The language comes from the path's extension alone, never from the unreliable record.  Parsing is
one narrow pass in Arrow batches: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.syntax import compose, lexer, python as python_syntax
from quarry.sources.tables import spread

PARSED = "file_id string, repo string, path string, language string, parse_status string, parse_error string, fault_line int, fault_count int, faults array<struct<line:int,message:string>>"
_FAULTS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))
_SCHEMA = pa.schema([("file_id", pa.string()), ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("parse_status", pa.string()), ("parse_error", pa.string()), ("fault_line", pa.int32()), ("fault_count", pa.int32()), ("faults", _FAULTS)])
#: Texts are handed to the parsers in slices of so many rows, so that one Arrow batch isn't held twice.
SLICE = 256


def faults_of(text: str, language: str) -> tuple[list[tuple[int, str]], int]:
    """All faults of ``text`` as (line, message), in the order found, and their number; none if it is valid.

    Empty, blank and comment-only texts are valid.
    """
    shape = lexer.shape(text, language)
    if language == "python":
        return python_syntax.check(shape)
    return compose.check(shape, language)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            status, error, line, count, faults = [], [], [], [], []
            for text, language in zip(batch.column("content").to_pylist(), batch.column("lang").to_pylist()):
                found, n = ([], 0) if not text else faults_of(text, language)
                status.append("UNKNOWN" if text is None else "FAILED" if n else "OK" if text.strip("﻿ \t\r\n\f") else "EMPTY")
                error.append(found[0][1] if n else None)
                line.append(found[0][0] if n else None)
                count.append(n)
                faults.append([{"line": a, "message": b} for a, b in found])
            cols = [batch.column(c) for c in ("file_id", "repo", "path", "lang")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(status), pa.array(error, pa.string()), pa.array(line, pa.int32()), pa.array(count, pa.int32()), pa.array(faults, _FAULTS)], schema=_SCHEMA)


def code_files(corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """file_id, repo, path, lang, content of the files whose extension belongs to a code language with a parser.

    The registry has one row per file extension, a list that doesn't grow with the corpus, and is broadcast.
    """
    known = registry.where("is_code").select(F.lower("extension").alias("ext"), F.lower("language").alias("lang")).where(F.col("lang").isin(*lexer.LANGUAGES)).dropDuplicates(["ext"])
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return corpus.select("file_id", "repo", "path", "content", ext.alias("ext")).join(F.broadcast(known), "ext").select("file_id", "repo", "path", "lang", "content")


def parse_files(corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per code file: its status, first fault (message and line), number of faults, and the faults.

    ``parse_status`` is OK, FAILED, EMPTY (nothing but blanks; valid) or UNKNOWN (content is null).  All
    faults of a file are kept, in the order found.  Repeated rows give repeated results; other columns of ``corpus`` are ignored.
    """
    return spread(code_files(corpus, registry), "file_id").mapInArrow(_parse, PARSED)


def invalid_files(corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """file_id of each code file whose content is not valid syntax, once."""
    return parse_files(corpus, registry).where("parse_status = 'FAILED'").select("file_id").distinct()


def parse_rates(corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """repo, language, files, failed, rate (of files that fail) and accepted (the rate of those that don't)."""
    return (
        parse_files(corpus, registry)
        .groupBy("repo", "language")
        .agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "FAILED").alias("failed"))
        .withColumn("rate", F.round(F.col("failed") / F.col("files"), 6))
        .withColumn("accepted", F.round(1 - F.col("failed") / F.col("files"), 6))
    )
