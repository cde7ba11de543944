"""Files that nobody wrote by hand in their repository: generated, minified, vendored, or data saved as code.

Evidence is the path (directories and file names that tools and package managers use), the file's own
notice (in a comment, never in a string), and the layout of the text: line lengths, the shares of white
space and alphanumeric characters, the density of numeric literals, and long encoded runs, with
thresholds per language.  One narrow pass; byte histograms do the counting, and patterns run only over
the few texts whose histogram or words call for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.notices import notice_kind
from quarry.sources.tables import spread

# Directories of other projects' code, and of tools' output.
VENDOR_DIRS = "vendor vendored _vendor third_party third-party thirdparty node_modules bower_components site-packages dist-packages external externals extern deps godeps jspm_packages pods".split()
GENERATED_DIRS = "generated __generated__ auto-generated autogenerated autogen generated-sources generated_sources generated-src dist".split()
# Names of files that tools write.
GENERATED_NAMES = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|js|ts)|\.pb\.gw\.go|[._-]generated\.\w+|_gen\.go|\.gen\.\w+|zz_generated[^/]*|\.g\.(?:ts|dart|cs)|OuterClass\.java|\.designer\.cs)"
LOCK_NAMES = r"(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock)"
MINIFIED_NAMES = r"(?:[.-]min\.(?:m?js|css)|\.bundle\.m?js|\.prod\.m?js|-\d+\.\d+\.\d+(?:\.min)?\.m?js|\.(?:m?js|css)\.map)"

@dataclass(frozen=True)
class Layout:
    """Thresholds of one language.  Compacted text has long lines on the whole, a very long one, and little white
    space; how little depends on how much a language's own style has (indentation, blanks around operators)."""

    mean_line: float  # compacted: mean line length at least
    max_line: int  # compacted: longest line at least
    space: float  # compacted: share of white space at most
    data: float  # data: share of numeric literals and encoded runs, of all characters but white space, at least
    literals: int  # data: so many numeric literals at least, unless there is an encoded run


LAYOUTS = {
    "javascript": Layout(120, 300, 0.09, 0.5, 24),
    "typescript": Layout(130, 300, 0.10, 0.5, 24),
    "java": Layout(150, 320, 0.12, 0.5, 16),
    "go": Layout(140, 320, 0.085, 0.5, 16),
    "python": Layout(180, 340, 0.10, 0.5, 24),
}
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
NUMBER = re.compile(r"(?<![\w.\"'])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)[lLfFdDn]?(?![\w.\"'])[ \t]*[,;]?")
#: A long encoded run; a digest behind the name of its algorithm points to data and is none.
ENCODED = re.compile(r"(?<![0-9A-Za-z+/=_])(?<!sha\d{3}[:-])(?<!sha1[:-])(?<!md5[:-])(?:[A-Za-z0-9+/=_]|\\x[0-9a-fA-F]{2}|\\[0-7]{3}){40,}")


def language_of(path: str | None) -> str | None:
    m = re.search(r"\.(\w+)$", path or "")
    return EXTENSIONS.get(m[1].lower()) if m else None


def path_kind(path: str | None) -> str | None:
    """``vendored``, ``generated`` or ``minified`` by directories and name; None otherwise."""
    if not path:
        return None
    parts = re.split(r"[/\\]+", path)
    dirs = {p.lower() for p in parts[:-1]}
    if dirs.intersection(VENDOR_DIRS):
        return "vendored"
    if dirs.intersection(GENERATED_DIRS) or _GENERATED_NAME.search(parts[-1]):
        return "generated"
    if _MINIFIED_NAME.search(parts[-1]):
        return "minified"
    return None


_GENERATED_NAME = re.compile(rf"{GENERATED_NAMES}$|^{LOCK_NAMES}$", re.I)
_MINIFIED_NAME = re.compile(rf"{MINIFIED_NAMES}$", re.I)


_SPACE, _ALNUM, _DIGIT = (np.array([f(chr(b)) for b in range(256)]) for f in (lambda c: c in " \t\r\n\f\v", lambda c: c.isascii() and c.isalnum(), lambda c: c in "0123456789"))


def layout(text: str) -> dict[str, float]:
    """Layout statistics: bytes, lines, mean and longest line, and the shares of white space, alphanumeric
    characters and digits."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(data)
    if not n:
        return {"bytes": 0, "lines": 0, "mean_line": 0.0, "max_line": 0, "space": 0.0, "alnum": 0.0, "digit": 0.0}
    histogram = np.bincount(data, minlength=256)
    ends = np.flatnonzero(data == 10)
    lengths = np.diff(np.concatenate([[-1], ends, [n]])) - 1
    lines = len(ends) + (1 if data[-1] != 10 else 0)
    return {
        "bytes": n,
        "lines": lines,
        "mean_line": (n - len(ends)) / lines,
        "max_line": int(lengths.max()),
        "space": float(histogram[_SPACE].sum()) / n,
        "alnum": float(histogram[_ALNUM].sum()) / n,
        "digit": float(histogram[_DIGIT].sum()) / n,
    }


def data_statistics(text: str) -> tuple[float, int, int]:
    """(share, literals, encoded): of the characters but white space the share that numeric literals (with their
    commas) and encoded runs of at least 40 characters make up; how many literals there are, and characters in runs."""
    whole = sum(map(len, text.split())) or 1
    rest, n = ENCODED.subn("", text)
    encoded = len(text) - len(rest)
    numbers = NUMBER.findall(rest)
    return (encoded + sum(len(x.replace(" ", "").replace("\t", "")) for x in numbers)) / whole, len(numbers), encoded


def layout_kind(text: str, language: str | None, stats: dict[str, float]) -> str | None:
    """``minified`` or ``data`` by the layout of a file in a known language; None otherwise.  A file of any size
    is judged."""
    limits = LAYOUTS.get(language or "")
    if limits is None:
        return None
    if stats["digit"] >= 0.1 or stats["space"] < 0.12 or stats["mean_line"] > 55 or stats["alnum"] > 0.85:
        share, literals, encoded = data_statistics(text)
        if share >= limits.data and (encoded or literals >= limits.literals):
            return "data"
    if stats["mean_line"] >= limits.mean_line and stats["max_line"] >= limits.max_line and stats["space"] <= limits.space:
        return "minified"
    return None


CLASSES = "file_id string, repo string, path string, is_generated boolean, kind string, evidence string, line_count int, mean_line double, max_line int, space_share double, alnum_share double"


def classify(path: str | None, text: str | None) -> tuple[str | None, str | None, dict[str, float]]:
    """(kind, evidence, layout) of one file; kind is None for hand-written source."""
    stats = layout(text or "")
    kind = path_kind(path)
    if kind:
        return kind, "path", stats
    if not text:
        return None, None, stats
    language = language_of(path)
    kind = notice_kind(text, language)
    if kind:
        return kind, "notice", stats
    kind = layout_kind(text, language, stats)
    return kind, "layout" if kind else None, stats


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            found = [classify(p, t) for p, t in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("file_id", "repo", "path")),
                    pa.array([k is not None for k, _, _ in found], pa.bool_()),
                    pa.array([k for k, _, _ in found], pa.string()),
                    pa.array([e for _, e, _ in found], pa.string()),
                    pa.array([s["lines"] for *_, s in found], pa.int32()),
                    pa.array([s["mean_line"] for *_, s in found], pa.float64()),
                    pa.array([s["max_line"] for *_, s in found], pa.int32()),
                    pa.array([s["space"] for *_, s in found], pa.float64()),
                    pa.array([s["alnum"] for *_, s in found], pa.float64()),
                ],
                names=[x.split()[0] for x in CLASSES.split(", ")],
            )


def classify_files(corpus: DataFrame) -> DataFrame:
    """One row per row of ``corpus``: is_generated, kind (generated, minified, vendored, data or null), the
    evidence (path, notice or layout) and the layout statistics.

    Null and empty contents are judged by path alone; a null path is no evidence.  Other columns are ignored.
    """
    return spread(corpus.select("file_id", "repo", "path", "content"), "file_id").mapInArrow(_classify, CLASSES)


LAYOUT = "file_id string, repo string, path string, language string, bytes bigint, lines int, mean_line double, max_line int, space_share double, alnum_share double, digit_share double, data_share double, numeric_literals int, encoded_chars bigint, layout string"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                language, stats = language_of(path), layout(text or "")
                share, literals, encoded = data_statistics(text or "")
                rows.append((language, stats["bytes"], stats["lines"], stats["mean_line"], stats["max_line"], stats["space"], stats["alnum"], stats["digit"], share, literals, encoded, layout_kind(text or "", language, stats)))
            types = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file_id", "repo", "path")), *columns], names=[x.split()[0] for x in LAYOUT.split(", ")])


def layout_statistics(corpus: DataFrame) -> DataFrame:
    """One row per row of ``corpus``: its layout statistics, and ``layout``, which is minified, data or null by the
    thresholds of its language.  Null contents have 0 bytes; a path without a known language has statistics only."""
    return spread(corpus.select("file_id", "repo", "path", "content"), "file_id").mapInArrow(_measure, LAYOUT)


def path_generated(path) -> F.Column:
    """The path rules of ``path_kind`` as an expression that stays in the JVM."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    dirs = "|".join(re.escape(d) for d in [*VENDOR_DIRS, *GENERATED_DIRS])
    return low.rlike(rf"(?:^|/)(?:{dirs})/") | low.rlike(rf"(?i)(?:{GENERATED_NAMES}|{MINIFIED_NAMES})$") | low.rlike(rf"(?i)(?:^|/){LOCK_NAMES}$")


def generated_files(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """file_id of each file of ``records`` that isn't hand-written, once.

    A record without a row in ``corpus`` is judged by its path.  is_generated of the record is not used.
    """
    named = records.where("id is not null").where(path_generated(F.col("path"))).select(F.col("id").alias("file_id"))
    judged = classify_files(corpus).where("is_generated").select("file_id")
    known = records.select(F.col("id").alias("file_id"))
    return judged.join(known, "file_id", "left_semi").unionByName(named).distinct()
