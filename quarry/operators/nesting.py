"""Containment of intervals: the innermost interval around each interval or point.

A self-join of intervals is quadratic in a file's declarations.  Here each key's rows come sorted by
(start, -end) and one pass keeps the stack of open intervals, so the cost is that of the sort.  Rows
stream through; no key's rows are ever held together, only the open intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, stack = None, []
    for batch in batches:
        out = []
        for k, start, end, ident, point in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "end", "id", "point"))):
            if k != key:
                key, stack = k, []
            while stack and stack[-1][0] < start:
                stack.pop()
            out.append(next((i for e, i in reversed(stack) if e >= end), None))
            if not point:
                stack.append((end, ident))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("point"), pa.array(out, pa.string())], names=["key", "id", "point", "parent"])


def innermost(intervals: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """key, id, parent of each interval, or of each point if ``points`` is given; parent is null at the top.

    Both inputs have key, id (string), start and end (bigint, both inside).  The parent is the containing
    interval that starts last, of those the one that ends first; equal intervals contain the one with the
    greater id.  Rows with a null in key, start or end are left out.
    """
    cols = ["key", "id", "start", "end"]
    rows = intervals.select(*cols).withColumn("point", F.lit(False))
    if points is not None:
        rows = rows.unionByName(points.select(*cols).withColumn("point", F.lit(True)))
    rows = rows.where("key is not null and start is not null and end is not null")
    nested = rows.repartition("key").sortWithinPartitions("key", "start", "point", F.desc("end"), "id").select(*cols, "point").mapInArrow(_stack, "key string, id string, point boolean, parent string")
    return (nested if points is None else nested.where("point")).drop("point")


def offset(line, col):
    """A line and a column as one sortable number; a column of any int stays within its line."""
    return line.cast("bigint") * 2**31 + col


def attach_docs(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """id (of the symbol), documentation: of each symbol the earliest documentation node whose innermost
    enclosing symbol it is.  ``docs`` has key, id, start, end, text; ``symbols`` key, id, start, end."""
    owned = innermost(symbols, docs).where("parent is not null").select("key", F.col("id").alias("doc_id"), F.col("parent").alias("id"))
    texts = docs.select("key", F.col("id").alias("doc_id"), "start", "text")
    return owned.join(texts, ["key", "doc_id"]).groupBy("id").agg(F.min_by("text", F.struct("start", "doc_id")).alias("documentation"))
