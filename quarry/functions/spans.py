"""Source spans: struct<start_line, start_col, end_line, end_col>; lines from 1, columns from 0 in bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"


def point(line: Column, col: Column) -> Column:
    return F.struct(line.cast("int").alias("start_line"), col.cast("int").alias("start_col"), line.cast("int").alias("end_line"), col.cast("int").alias("end_col"))


def whole_file(lines: Column) -> Column:
    one, zero = F.lit(1), F.lit(0)
    return F.struct(one.alias("start_line"), zero.alias("start_col"), F.greatest(one, lines).cast("int").alias("end_line"), zero.alias("end_col"))


def line_count(span: Column) -> Column:
    return span["end_line"] - span["start_line"] + 1


def contains_line(span: Column, line: Column) -> Column:
    return (span["start_line"] <= line) & (line <= span["end_line"])


def is_zero_width(span: Column) -> Column:
    return (span["start_line"] == span["end_line"]) & (span["start_col"] == span["end_col"])


def text(span: Column) -> Column:
    return F.format_string("%d:%d-%d:%d", span["start_line"], span["start_col"], span["end_line"], span["end_col"])


def rules(span: Column) -> dict[str, Column]:
    """rule -> is it broken?"""
    ends_before = F.struct(span["end_line"], span["end_col"]) < F.struct(span["start_line"].alias("end_line"), span["start_col"].alias("end_col"))
    return {"start_line": span["start_line"] < 1, "end_line": span["end_line"] < 1, "start_col": span["start_col"] < 0, "end_col": span["end_col"] < 0, "order": ends_before}
