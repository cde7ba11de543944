"""Content-addressed identifiers as column expressions.

An id is a prefix and the first 16 hex digits of the SHA-1 of its parts, joined by the unit separator; a
null part is an empty slot (``concat_ws`` would drop it).  No id contains the model version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The prefixes of the kinds of ids, the separator and the length of the digest.
FILE, SYMBOL, RELATIONSHIP, EVIDENCE, CHUNK, VERSION, UNRESOLVED = "file_", "sym_", "rel_", "ev_", "chunk_", "mv_", "unresolved:"
SEPARATOR, DIGITS = "\x1f", 16


def digest_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix`` and the digest of ``parts``."""
    slots = F.array(*((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.array_join(slots, SEPARATOR, "")), 1, DIGITS))


def file_id(path: Column | str) -> Column:
    return digest_id(FILE, path)


def symbol_id(path, symbol_type, qualified_name) -> Column:
    return digest_id(SYMBOL, path, symbol_type, qualified_name)


def relationship_id(source, kind, target_key, line, col) -> Column:
    return digest_id(RELATIONSHIP, source, kind, target_key, line, col)


def evidence_id(entity, file, start_line, end_line, source) -> Column:
    return digest_id(EVIDENCE, entity, file, start_line, end_line, source)


def chunk_id(symbol, chunk_type) -> Column:
    return digest_id(CHUNK, symbol, chunk_type)


def unresolved_target(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{UNRESOLVED}{kind}:"), name)


def is_unresolved(target: Column | str) -> Column:
    return (F.col(target) if isinstance(target, str) else target).startswith(UNRESOLVED)


def content_hash(content: Column | str) -> Column:
    """``sha256:`` and the digest of the raw bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.col(content) if isinstance(content, str) else content, 256))


def combined_hash(hashes: Column | str) -> Column:
    """An order-independent digest of a bag of hashes: repeated hashes count.  For one group's worth."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), "\n"), 256)


#: Hashes that are joined to one piece on their way to the digest.
PIECE = 8192


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    range_no, seq, held = TaskContext.get().partitionId(), 0, []
    piece = lambda some: pa.RecordBatch.from_arrays([pa.array([range_no]), pa.array([seq]), pa.array(["\n".join(some).encode()], pa.binary())], names=["range_no", "seq", "piece"])
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= PIECE:
            yield piece(held[:PIECE])
            held, seq = held[PIECE:], seq + 1
    if held:
        yield piece(held)


def _digest_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, first = hashlib.sha256(), True
    for batch in batches:
        for range_no, piece in zip(batch.column("range_no").to_pylist(), batch.column("piece").to_pylist()):
            if range_no >= 0:
                digest.update(piece if first else b"\n" + piece)
                first = False
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["digest"])


def version_id(files: DataFrame, content_hash_col: str = "content_hash") -> DataFrame:
    """One row, model_version: the identity of a corpus, from the sorted list of its files' hashes.

    The definition needs one digest over the whole sorted list, which is a sequence by nature.  The hashes are sorted in
    ranges over all tasks and joined to pieces of 8,192; one task streams the pieces in order through the digest and
    holds no more than one batch of them.  ``tree_version_id`` has no such stream.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = files.where(F.col(content_hash_col).isNotNull()).select(F.col(content_hash_col).alias("h"))
    pieces = hashes.repartitionByRange(n, "h").sortWithinPartitions("h").mapInArrow(_pieces, "range_no bigint, seq bigint, piece binary")
    none = files.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("range_no"), F.col("id").alias("seq"), F.lit(b"").alias("piece"))  # so that an empty corpus has a digest too
    one = pieces.unionByName(none).repartition(1).sortWithinPartitions("range_no", "seq").mapInArrow(_digest_in_order, "digest string")
    return one.select(F.concat(F.lit(VERSION), F.substring(F.sha1("digest"), 1, DIGITS)).alias("model_version"))


def bag_digest(digest_col: str) -> Column:
    """An aggregate over any number of rows in any order: the sums of the eight 32-bit words of each row's hexadecimal
    SHA-256 digest, and the number of rows, hashed.  Partial sums combine before the shuffle; repeated rows count.
    It tells tables apart; it is no proof against someone who constructs rows of equal sums."""
    word = lambda i: F.sum(F.conv(F.substring(digest_col, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws(",", F.count(digest_col).cast("string"), *(F.coalesce(word(i), F.lit(0)).cast("string") for i in range(8))), 256)


def tree_version_id(files: DataFrame, content_hash_col: str = "content_hash") -> DataFrame:
    """One row, model_version, for corpora of any size, as ``bag_digest`` of the hashes.  Equal bags give equal versions;
    the values differ from ``version_id``'s."""
    hashed = files.where(F.col(content_hash_col).isNotNull()).select(F.sha2(content_hash_col, 256).alias("d"))
    return hashed.agg(F.concat(F.lit(VERSION), F.substring(F.sha1(bag_digest("d")), 1, DIGITS)).alias("model_version"))
