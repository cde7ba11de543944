"""The parse operator: files in, one row of facts per file out, by registered backends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import languages
from quarry.sources.tables import spread
from quarry.syntax.facts import PARSED, Backend, Facts
from quarry.syntax.python_ast import PythonBackend
from quarry.syntax.rules import RulesBackend

#: language -> backend class; more may be registered before a query is built.
BACKENDS: dict[str, type[Backend]] = {"python": PythonBackend, **{key: RulesBackend for key, *_, code, _ in languages.rows() if code and key != "python"}}


def register(language: str, backend: type[Backend]) -> None:
    BACKENDS[language] = backend


def parse_one(source: bytes, language: str | None, path: str, backends: dict[str, type[Backend]] | None = None) -> Facts:
    """The facts of one file.  No backend: UNSUPPORTED with a warning.  A backend's own failure: FAILED."""
    backend = (backends or BACKENDS).get(language or "")
    if backend is None:
        f = Facts(parse_status="UNSUPPORTED" if source.strip() else "EMPTY")
        f.say("WARNING", "parse.grammar_unavailable", f"no backend for {language}")
        return f
    try:
        return backend().facts(source, language, path)
    except Exception as error:  # one file's failure stays its own
        f = Facts(parse_status="FAILED", parse_error=f"{type(error).__name__}: {error}")
        f.say("ERROR", "parse.internal", f.parse_error, None, "file")
        return f


def parse_files(files: DataFrame, slices: bool = False, balanced: bool = False) -> DataFrame:
    """One row of facts per file of ``files`` (path, content, and language if known).

    Parsing is narrow, one Arrow batch at a time; a scan of few splits is spread first, unless ``balanced`` says that the
    rows lie well already.  Null content gives no row.
    ``slices`` also cuts each symbol's lines from the text at hand; where they aren't needed, no text leaves the pass.
    """
    language = F.col("language") if "language" in files.columns else languages.detect(F.col("path"))
    rows = files.where("content is not null").select("path", F.col("content").cast("binary").alias("content"), language.alias("language"))
    if not balanced:
        rows = spread(rows, "path")
    backends = dict(BACKENDS)

    def facts(path: str, content: bytes, language: str | None) -> dict:
        f = parse_one(content, language, path, backends)
        if slices:
            f.cut_slices(content.decode("utf-8", "replace"))
        return f.row(path)

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                yield pa.RecordBatch.from_pylist([facts(p, c, g) for p, c, g in zip(*(part.column(x).to_pylist() for x in ("path", "content", "language")))], schema)

    return rows.mapInArrow(run, PARSED)
