"""An index of vectors: lists around centroids, probed by the queries and ranked exactly.

The centroids are fitted on a bounded sample; every vector is put into the list of its nearest centroid.  A query probes
the lists of its nearest centroids and ranks all their vectors by exact cosine.  A list of many vectors is cut into
blocks, and so are the queries of a list, so no task holds more than one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quarry.operators.search import norm

#: The sample that centroids are fitted on, the most lists, and the vectors and queries of one block.
SAMPLE, MOST_LISTS, BLOCK, QUERY_BLOCK = 20_000, 4096, 20_000, 2_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").where(norm(F.col("embedding")) > 0)


def fit(vectors: DataFrame, lists: int | None = None, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means over a sample of at most ``SAMPLE`` vectors; about the root of the table's size."""
    usable = _usable(vectors)
    total = usable.count()
    lists = min(MOST_LISTS, lists or max(1, int(total**0.5)))
    rows = usable.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    x = _matrix(rows.column("embedding"))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        filled = np.linalg.norm(sums, axis=1) > 0
        centroids[filled] = sums[filled] / np.linalg.norm(sums[filled], axis=1, keepdims=True)
    return centroids


def _probe(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """vec_id, embedding, list: a row for each of the ``probes`` nearest lists."""
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            near = np.argpartition(-(x @ centroids.T), probes - 1, axis=1)[:, :probes]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("embedding").take(rows), pa.array(near.reshape(-1).astype(np.int32))], names=["vec_id", "embedding", "list"])

    return _usable(vectors).mapInArrow(run, "vec_id bigint, embedding array<float>, list int")


def build(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The index: vec_id, embedding, list of every vector that has a direction."""
    return _probe(vectors, centroids, 1)


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, vec_id, score, position: the ``k`` nearest vectors in the probed lists, never the query itself; scores
    rounded to 6 places, ties by vec_id."""
    blocks = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each list, of which there are MOST_LISTS at most
    held = index.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "embedding")
    asked = _probe(queries, centroids, probes)
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    shape = blocks.join(parts, "list")
    asked = asked.join(F.broadcast(shape), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "part", F.col("vec_id").alias("query_id"), "embedding")
    held = held.join(F.broadcast(shape.select("list", "parts")), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            scores = np.round(_matrix(left.column("embedding")) @ _matrix(right.column("embedding")).T, 6)
            for q, row in zip(left.column("query_id").to_pylist(), scores):
                row = np.where(ids == q, -2.0, row)
                limit = np.partition(row, max(0, len(row) - k))[max(0, len(row) - k)]
                some = np.flatnonzero((row >= limit) & (row > -2.0))
                some = some[np.lexsort((ids[some], -row[some]))][:k]
                out["query_id"] += [q] * len(some)
                out["vec_id"] += ids[some].tolist()
                out["score"] += row[some].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    key = ["list", "block", "part"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(rank, "query_id bigint, vec_id bigint, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
