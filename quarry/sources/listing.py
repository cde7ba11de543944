"""Files below a root: listed by the executors with ignored directories left unopened, and read only where needed.

Directories are walked level by level as a table.  A task walks the subtrees of its directories itself until it has
listed ``MOST`` entries, and hands the directories that are left to the next round, so small trees take one round and
large ones spread over the cluster.  Names that begin with ``_`` or ``.`` are files like any others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.sources.tables import cut

#: Entries that a task lists in one round.
MOST = 20_000
LISTED = "path string, length bigint, kind string"
#: Bytes of content in one Arrow batch, and about how many a task reads.
BATCH_BYTES, TASK_BYTES = 32 << 20, 128 << 20


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))


def _walk(root: str, ignored: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        for batch in batches:
            stack, found = batch.column("path").to_pylist(), []
            while stack and len(found) < MOST:
                directory = stack.pop()
                try:
                    entries = files.get_file_info(fs.FileSelector(f"{base}/{directory}" if directory else base))
                except OSError:
                    found.append((directory + "/", None, "unreadable"))
                    continue
                for e in entries:
                    path = f"{directory}/{e.base_name}" if directory else e.base_name
                    if e.type == fs.FileType.Directory:
                        if e.base_name.lower() in ignored:
                            found.append((path + "/", None, "pruned"))
                        else:
                            stack.append(path)
                    elif e.type == fs.FileType.File:
                        found.append((path, e.size, "file"))
            found += [(d, None, "open") for d in stack]
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["path", "length", "kind"])

    return run


def list_files(spark: SparkSession, root: str, ignored_directories: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to ``root``), length, kind: ``file``, or ``pruned`` for an ignored directory, whose path ends with
    a slash and which isn't opened.  Raises NotADirectoryError if ``root`` is no directory."""
    files, base = filesystem(root)
    if files.get_file_info(base).type != fs.FileType.Directory:
        raise NotADirectoryError(root)
    walk = _walk(root, frozenset(d.lower() for d in ignored_directories))
    frontier = spark.createDataFrame([("",)], "path string")
    done = None
    while True:
        step = cut(frontier.mapInArrow(walk, LISTED))
        listed = step.where("kind in ('file', 'pruned')")
        done = listed if done is None else done.unionByName(listed)
        frontier = step.where("kind = 'open'").select("path").repartition(spark.sparkContext.defaultParallelism)
        if frontier.isEmpty():
            return done


def _read(root: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        for batch in batches:
            contents, size, first = [], 0, 0

            def rows(upto: int) -> pa.RecordBatch:
                some = batch.slice(first, upto - first)
                return pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(contents, pa.binary())], names=[*columns, "content"])

            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with files.open_input_stream(f"{base}/{path}") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
                size += len(contents[-1] or b"")
                if size >= BATCH_BYTES:
                    yield rows(i + 1)
                    contents, size, first = [], 0, i + 1
            if contents:
                yield rows(batch.num_rows)

    return run


def with_content(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` (path, length and more) with the bytes of each file; null where a file can't be read."""
    total = listed.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema) + ", content binary"
    return listed.repartition(tasks, "path").mapInArrow(_read(root, listed.columns), schema)
