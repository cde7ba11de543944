"""Filling fixed-capacity containers with documents: sum-of-squares online packing.

Texts are counted in tokens where they lie, and only (doc_id, tokens) is shuffled, which also drops
repeated rows.  Every task then packs its documents one after the other.  It keeps an array that counts its open
containers by fill level, and puts each item where the sum of the squared counts grows least: into an
open container of some level, or a new one.  A text larger than a container fills whole containers of
its own first; only its rest is an item.  Containers that tasks leave open are items of a second round,
in which few tasks pack them together; the placements of their documents are shifted accordingly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.tokenize import token_counts
from quarry.sources.tables import cut

CAPACITY = 2048
#: Containers of so many first-round tasks are packed together by one task of the second round.
TASKS_TOGETHER = 64


class SumOfSquares:
    """Online packer of items of 1 to ``capacity`` units."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        #: The open containers of each level, as stacks of container numbers.
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) of an item; the sum of squares of the level counts grows least."""
        c, n = self.capacity, self.count
        if not 0 < size <= c:
            raise ValueError(f"size {size}")
        fresh = 0 if size == c else 2 * n[size] + 1
        level, least = 0, fresh
        if size < c:
            levels = n[1 : c - size + 1]
            if levels.any():
                growth = 2 * (n[1 + size : c + 1] - levels) + 2
                growth[-1] = 1 - 2 * levels[-1]  # the container is full, and no longer counts
                growth = np.where(levels > 0, growth, np.iinfo(np.int64).max)
                best = int(growth.argmin())
                # of equally good levels the fullest
                best = len(growth) - 1 - int((growth[::-1] == growth[best]).argmax())
                if growth[best] <= least:
                    level = best + 1
        if level:
            container = self.open[level].pop()
            n[level] -= 1
        else:
            container = self.used
            self.used += 1
        filled = level + size
        if filled < c:
            n[filled] += 1
            self.open[filled].append(container)
        return container, level


PLACED = "doc_id bigint, piece_no int, from_token bigint, to_token bigint, task int, container bigint, at_token int"
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("from_token", pa.int64()), ("to_token", pa.int64()), ("task", pa.int32()), ("container", pa.int64()), ("at_token", pa.int32())])


def _first_round(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packer = SumOfSquares(capacity)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rows = []
                for doc, n in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()):
                    done = piece = 0
                    while done < n:
                        size = min(capacity, n - done)
                        container, level = packer.place(size)
                        rows.append((doc, piece, done, done + size, task, container, level))
                        done += size
                        piece += 1
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PLACED)], schema=_PLACED)

    return run


def _second_round(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        packer = SumOfSquares(capacity)
        for batch in batches:
            where = [packer.place(f) for f in batch.column("fill").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("task"), batch.column("container"), pa.array([group] * len(where), pa.int32()), pa.array([w[0] for w in where], pa.int64()), pa.array([w[1] for w in where], pa.int32())],
                names=["task", "container", "merged_task", "merged_container", "shift"],
            )

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece_no, from_token, to_token, container_id, at_token: where each token of each document is.

    A piece is the tokens [from_token, to_token) of its document, and stands at at_token of its
    container.  Only documents of more than ``capacity`` tokens have several pieces.  Null and empty
    texts have no tokens and no row.  doc_id is a key: a repeated row counts once.
    """
    sizes = token_counts(documents, ranks_path).where("tokens > 0").sortWithinPartitions("doc_id")
    placed = cut(sizes.mapInArrow(_first_round(capacity), PLACED))
    fills = placed.groupBy("task", "container").agg(F.sum(F.col("to_token") - F.col("from_token")).cast("int").alias("fill"))
    left = fills.where(F.col("fill") < capacity)
    tasks = placed.rdd.getNumPartitions()
    groups = max(1, -(-tasks // TASKS_TOGETHER))
    merged = (
        left.repartition(groups, F.floor(F.col("task") / TASKS_TOGETHER)).sortWithinPartitions(F.desc("fill"), "task", "container").mapInArrow(_second_round(capacity), "task int, container bigint, merged_task int, merged_container bigint, shift int")
    )
    together = placed.join(merged, ["task", "container"], "left")
    name = F.when(F.col("merged_task").isNull(), F.concat_ws("-", F.lit("a"), "task", "container")).otherwise(F.concat_ws("-", F.lit("b"), "merged_task", "merged_container"))
    return together.select("doc_id", "piece_no", "from_token", "to_token", name.alias("container_id"), (F.col("at_token") + F.coalesce("shift", F.lit(0))).alias("at_token"))


def container_fill(placements: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, pieces, used, unused of each container."""
    used = F.sum(F.col("to_token") - F.col("from_token"))
    return placements.groupBy("container_id").agg(F.count("*").alias("pieces"), used.alias("used"), (F.lit(capacity) - used).alias("unused"))
