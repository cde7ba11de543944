"""Near-duplicate texts with small edits: tensored minhash banding, then exact verification.

A text is the set of its runs of three consecutive tokens.  Texts with equal sets are collapsed to one
representative first, so copies cost nothing further on.  Each representative gets a few *half*
signatures of two minhashes; every pair of halves forms the key of one table.  ``HALVES`` halves thus
yield HALVES * (HALVES - 1) / 2 tables of four minhashes from only 2 * HALVES minhashes: about the square
root of what independent tables would need.  Two texts of similarity s meet if two halves agree, each
with probability s * s: with 14 halves 99.9 % of the pairs at 0.7 do, and practically all above 0.75.
Candidates are verified on the whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.operators.components import connected_components
from quarry.sources.tables import cut, spread

LEAST_TOKENS, SHINGLE, HALVES, ROWS = 30, 3, 14, 2
#: Similarity threshold as a fraction of integers, so that verification is exact.
THRESHOLD = (7, 10)

_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_RNG = np.random.default_rng(77003)
_MULTIPLY = _RNG.integers(1, 2**63, HALVES * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HALVES * ROWS, dtype=np.uint64)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[token] = value = xxhash.xxh3_64_intdigest(token)
        return value


_HASHES = _Hashes()


def shingle_set(text: str | None, least: int = LEAST_TOKENS) -> np.ndarray | None:
    """The sorted 64-bit hashes of the distinct runs of three tokens; None for a text of too few tokens.

    Tokens are the runs of ``[A-Za-z0-9_]`` in the lower-cased text.
    """
    tokens = _TOKEN.findall(text.lower()) if text else []
    if len(tokens) < max(least, SHINGLE):
        return None
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        mixed = _mix(h[:-2] * _PLACE[0] + (h[1:-1] * _PLACE[1] ^ (h[1:-1] >> np.uint64(29))) + (h[2:] * _PLACE[2] ^ (h[2:] >> np.uint64(31))))
    return np.unique(mixed)


SETS = "id string, digest binary, shingles array<bigint>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            ids, digests, sets, seen = [], [], [], set()
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                s = shingle_set(text)
                if s is None:
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                ids.append(i)
                digests.append(digest)
                sets.append(None if digest in seen else s.view(np.int64))
                seen.add(digest)
            offsets = np.cumsum([0, *(0 if s is None else len(s) for s in sets)]).astype(np.int32)
            values = np.concatenate([s for s in sets if s is not None]) if seen else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([s is None for s in sets], pa.bool_())) if sets else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(digests, pa.binary()), lists], names=["id", "digest", "shingles"])


def table_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of each set in every table: one row per set, one column per pair of halves."""
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(sets).view(np.uint64)
    halves = []
    with np.errstate(over="ignore"):
        for k in range(HALVES):
            value = np.zeros(len(sets), np.uint64)
            for r in range(ROWS):
                j = k * ROWS + r
                value = _mix(value + np.minimum.reduceat(_mix(flat * _MULTIPLY[j] + _ADD[j]), starts))
            halves.append(value)
        keys = [_mix(halves[i] * _PLACE[0] + halves[j] * _PLACE[1] + np.uint64(i * HALVES + j)) for i in range(HALVES) for j in range(i + 1, HALVES)]
    return np.stack(keys, 1).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            if not batch.num_rows:
                continue
            column = batch.column("shingles")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            keys = table_keys(np.split(flat, ends[:-1]))
            rids = np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(rids)], names=["key", "rid"])


#: Texts of a bucket up to which its pairs come from one task; a larger bucket is cut into blocks of about so many.
BLOCK = 512
_MET = "rid_a bigint, rid_b bigint, key bigint"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: the pairs within each bucket of at most BLOCK rows (key is null); the rows of a larger
    bucket as they are, with their place in the bucket as rid_b.  A batch may cut a bucket."""
    keys, rids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large_key, place = None, 0  # the large bucket that is open, and how many of its rows went out

    def batch_of(a: np.ndarray, b: np.ndarray, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key))], names=["rid_a", "rid_b", "key"])

    def within(keys: np.ndarray, rids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, step, found, rows = np.arange(len(keys)), 0, [], 0
        while len(at):
            step += 1
            at = at[at + step < len(keys)]
            at = at[keys[at] == keys[at + step]]
            found.append((rids[at], rids[at + step]))
            rows += len(at)
            if rows > 200_000 or not len(at):
                a, b = (np.concatenate(x) for x in zip(*found))
                if rows:
                    yield batch_of(np.minimum(a, b), np.maximum(a, b), None)
                found, rows = [], 0

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        rids = np.concatenate([rids, batch.column("rid").to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        small = ends - starts <= BLOCK
        small[0] &= keys[0] != large_key
        for i in np.flatnonzero(~small).tolist():
            key, some = int(keys[starts[i]]), rids[starts[i] : ends[i]]
            if key != large_key:
                large_key, place = key, 0
            yield batch_of(some, np.arange(place, place + len(some)), key)
            place += len(some)
        last = starts[-1] if small[-1] else len(keys)
        kept = np.repeat(small, ends - starts)[:last]
        yield from within(keys[:last][kept], rids[:last][kept])
        keys, rids = keys[last:], rids[last:]
    yield from within(keys, rids)


def bucket_pairs(keys: DataFrame) -> DataFrame:
    """rid_a <= rid_b of every two rows of ``keys`` (key, rid) with equal key; a pair of several buckets may be repeated.

    Buckets of at most BLOCK rows give their pairs in one streaming pass over the sorted rows.  The rows of a larger
    bucket are dealt to blocks, and each two blocks meet in a cell of their own, so no task has more than the pairs
    of two blocks; nothing is dropped."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(keys.repartition(n, "key").sortWithinPartitions("key", "rid").mapInArrow(_meet, _MET).distinct())
    small = met.where("key is null").select("rid_a", "rid_b")
    large = met.where("key is not null").select("key", F.col("rid_a").alias("rid"), (F.col("rid_b") / BLOCK).cast("int").alias("block"))
    dealt = large.join(large.groupBy("key").agg(F.max("block").alias("last")), "key")
    left = dealt.select("key", F.col("rid").alias("left_rid"), F.col("block").alias("x"), F.explode(F.sequence("block", "last")).alias("y"))
    right = dealt.select("key", F.col("rid").alias("right_rid"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"))
    cells = left.join(right.hint("shuffle_merge"), ["key", "x", "y"]).where("x < y or left_rid < right_rid")
    return small.unionByName(cells.select(F.least("left_rid", "right_rid").alias("rid_a"), F.greatest("left_rid", "right_rid").alias("rid_b")))


def similarity_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of a table of id and text.

    ``members``: id, rid; texts with the same rid have equal shingle sets.  ``links``: rid_a < rid_b, the
    pairs of representatives of similarity at least 0.7, each once.  Texts of fewer than 30 tokens, empty
    and null texts are in neither.  A repeated row counts once.
    """
    # texts are read twice, for the sets and for the members, so that the sets are written once only
    base = spread(texts.where("id is not null and text is not null").select("id", "text"), "id", ordered=True).mapInArrow(_sets, SETS)
    reps = cut(base.groupBy("digest").agg(F.first("shingles", ignorenulls=True).alias("shingles")).withColumn("rid", F.monotonically_increasing_id()))
    members = cut(base.select("id", "digest").distinct().join(reps.select("digest", "rid"), "digest").select("id", "rid"))
    candidates = bucket_pairs(reps.select("rid", "shingles").mapInArrow(_keys, "key bigint, rid bigint")).where("rid_a < rid_b").distinct()
    up, down = THRESHOLD
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    left = reps.select(F.col("rid").alias("rid_a"), F.col("shingles").alias("shingles_a"))
    right = reps.select(F.col("rid").alias("rid_b"), F.col("shingles").alias("shingles_b"))
    n, m = F.size("shingles_a"), F.size("shingles_b")
    verified = (
        candidates.join(left.hint("shuffle_merge"), "rid_a")
        .join(right.hint("shuffle_merge"), "rid_b")
        .where((n * down >= m * up) & (m * down >= n * up))
        .where(both * (up + down) >= up * (n + m))
        .select("rid_a", "rid_b")
    )
    return members, cut(verified)


def similar_pairs(texts: DataFrame) -> DataFrame:
    """chunk_id_a < chunk_id_b of every two ids whose sets have intersection / union >= 0.7, each pair once."""
    members, links = similarity_classes(texts)
    a, b = members.select(F.col("id").alias("a"), F.col("rid").alias("rid_a")), members.select(F.col("id").alias("b"), F.col("rid").alias("rid_b"))
    across = links.join(a, "rid_a").join(b, "rid_b").select("a", "b")
    equal = a.join(b, F.col("rid_a") == F.col("rid_b")).where("a < b").select("a", "b")
    ordered = across.unionByName(equal).where("a <> b")
    return ordered.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()


def similar_groups(texts: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """id, class_id, class_size of every id that is alike another one, directly or over others.

    Links are similarities of at least 0.7, and equal non-null content hashes of ``hashes`` (id,
    content_hash), for which texts of any length count.  ``class_id`` is the smallest id of the class.
    """
    members, links = similarity_classes(texts)
    first = members.groupBy("rid").agg(F.min("id").alias("first"))
    edges = members.join(first, "rid").select(F.col("id").alias("a"), F.col("first").alias("b"))
    edges = edges.unionByName(
        links.join(first.select(F.col("rid").alias("rid_a"), F.col("first").alias("a")), "rid_a").join(first.select(F.col("rid").alias("rid_b"), F.col("first").alias("b")), "rid_b").select("a", "b")
    )
    if hashes is not None:
        known = hashes.where("id is not null and content_hash is not null and content_hash <> ''").select("id", "content_hash").distinct()
        least = known.groupBy("content_hash").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        edges = edges.unionByName(known.join(least, "content_hash").select(F.col("id").alias("a"), "b"))
    classes = connected_components(edges.where("a <> b"))
    sizes = classes.groupBy("component").agg(F.count("*").alias("class_size"))
    return classes.join(sizes, "component").select(F.col("node").alias("id"), F.col("component").alias("class_id"), "class_size")


def function_texts(chunks: DataFrame) -> DataFrame:
    """id, symbol_id, text of the function and method chunks."""
    return chunks.where(F.col("chunk_type").isin("function", "method")).select("id", "symbol_id", "text")
