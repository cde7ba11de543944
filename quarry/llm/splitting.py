"""Splitting oversized texts at natural boundaries.

Texts over the limit are cut by a recursive hierarchy of separators: sections, paragraphs, lines,
sentences, words, characters.  A part that still exceeds a piece is cut at the next finer separator; the
resulting parts are packed greedily, in order, into pieces up to the limit.  Each piece but the first
begins with the last ``overlap`` tokens of the piece before.  One narrow pass, no shuffle, and only the
oversized rows leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 512, 32, 4

# Where a part may end, from coarse to fine; each pattern matches at the first character of the next part.
LEVELS = [
    ("section", re.compile(r"^(?=#{1,6} \S|(?:export |default |public |private |protected |static |abstract |final |async |pub )*(?:class|def|function|func|interface|enum|struct|type|impl|trait|module|namespace) )", re.M)),
    ("paragraph", re.compile(r"(?<=\n)(?:[ \t]*\r?\n)+")),
    ("line", re.compile(r"(?<=\n)(?=[^\n])")),
    ("sentence", re.compile(r"(?<=[.!?;:。])\s+")),
    ("word", re.compile(r"\s+")),
]
PIECES = "chunk_id string, source_hash bigint, piece_no int, piece_count int, start_char int, end_char int, overlap_chars int, boundary string, text string, token_count int"


def cuts(text: str, lo: int, hi: int, pattern: re.Pattern) -> list[int]:
    """Ends of the parts of text[lo:hi] at one level: separators stay with the part before them."""
    ends = []
    for m in pattern.finditer(text, lo, hi):
        at = m.end()
        if lo < at < hi and (not ends or at > ends[-1]):
            ends.append(at)
    return ends + [hi]


def parts(text: str, lo: int, hi: int, size: int, level: int = 0) -> list[tuple[int, str]]:
    """(end, kind of boundary) of consecutive parts of text[lo:hi], each at most ``size`` characters."""
    if hi - lo <= size:
        return [(hi, LEVELS[level - 1][0] if level else "end")]
    if level == len(LEVELS):
        return [(min(at + size, hi), "character") for at in range(lo, hi, size)]
    out = []
    at = lo
    name = LEVELS[level][0]
    for end in cuts(text, lo, hi, LEVELS[level][1]):
        if end - at <= size:
            out.append((end, name))
        else:
            finer = parts(text, at, end, size, level + 1)
            out += finer[:-1]
            out.append((end, name if end != hi else finer[-1][1]))
        at = end
    return out


def split_text(text: str, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, int, str]]:
    """(start, end, overlap characters, boundary at the end) of each piece; [] for an empty text.

    A piece is text[start:end] and begins with the last ``overlap`` tokens of the piece before; no piece
    exceeds ``limit`` tokens of four characters, and without the overlaps the pieces are the whole text.
    """
    whole, shared = limit * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    n = len(text)
    if not n:
        return []
    if n <= whole:
        return [(0, n, 0, "end")]
    pieces: list[tuple[int, int, int, str]] = []
    fresh = at = 0  # where the open piece's new text begins, and ends
    kind = ""
    room = whole
    for end, name in parts(text, 0, n, whole - shared):
        if end - fresh > room:
            pieces.append((fresh - shared if pieces else 0, at, shared if pieces else 0, kind))
            fresh, room = at, whole - shared
        at, kind = end, name
    pieces.append((fresh - shared if pieces else 0, n, shared if pieces else 0, "end"))
    return pieces


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows = []
            for chunk, digest, text in zip(*(batch.column(c).to_pylist() for c in ("id", "source_hash", "text"))):
                pieces = split_text(text)
                for k, (lo, hi, shared, kind) in enumerate(pieces):
                    rows.append((chunk, digest, k, len(pieces), lo, hi, shared, kind, text[lo:hi], (hi - lo) // CHARS_PER_TOKEN))
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def oversized_pieces(chunks: DataFrame) -> DataFrame:
    """The pieces of every chunk of more than 512 tokens (floor of characters / 4), in order of piece_no.

    ``token_count`` of the input is not trusted.  Null and empty texts, and texts within the limit, yield
    nothing.  A repeated row repeats its pieces; rows of one id with different texts are told apart by
    ``source_hash``.
    """
    big = chunks.where(F.length("text") >= (LIMIT_TOKENS + 1) * CHARS_PER_TOKEN)
    return big.select("id", F.xxhash64("text").alias("source_hash"), "text").mapInArrow(_split, PIECES)
