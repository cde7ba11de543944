"""What changed between consecutive full snapshots of a table.

The rows are range-partitioned and sorted by (repo, path); inside a range every key's rows lie side by
side in snapshot order.  One streaming pass per range is the two-pointer merge of all consecutive snapshot
pairs at once: it holds the row before and compares it with the row at hand.  Ranges are cut on
(repo, path), so a repository that holds a third of all rows is spread over many ranges.  Repeated rows of
one key are combined batch by batch before the range exchange, which is the only shuffle of the entries'
full width; what is left of them is resolved in the merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Copies of the snapshot calendar that a hot repository's rows are spread over.
SALTS = 16


def plain_path(path: Column) -> Column:
    """``/`` as the only separator, not doubled, without leading ``./``; case is kept.  Null stays null."""
    slashed = F.regexp_replace(path, r"[\\/]+", "/")
    return F.regexp_replace(slashed, r"^(\./)+", "")


def known_hash(content_hash: Column) -> Column:
    """The hex digits of a content hash in lower case without prefix; null where unknown (null or empty)."""
    digits = F.regexp_replace(F.lower(F.trim(content_hash)), r"^sha256:", "")
    return F.nullif(F.trim(digits), F.lit(""))


def snapshot_calendar(entries: DataFrame) -> DataFrame:
    """repo, numbers: every repository with the sorted numbers of its snapshots, of which there is one per delivery."""
    seen = entries.where("repo is not null and snapshot_no is not null")
    return seen.groupBy("repo").agg(F.sort_array(F.collect_set("snapshot_no")).alias("numbers"))


_KEY = ["repo", "path", "snapshot_no"]
ENTRIES = "repo string, path string, snapshot_no int, loaded_at timestamp_ntz, digest string"
RESOLVED = "repo string, path string, snapshot_no int, ordinal int, next_no int, digest string"
CHANGES = "repo string, snapshot_no int, path string, change_kind string"


def _same(table: pa.Table, columns: list[str]) -> pa.Array:
    """Whether each row but the last equals the next one in ``columns``, none of which is null."""
    out = None
    for c in columns:
        column = table.column(c).combine_chunks()
        equal = pc.equal(column[:-1], column[1:])
        out = equal if out is None else pc.and_(out, equal)
    return out


def _last_of_each(table: pa.Table) -> pa.Table:
    """Of sorted rows the last one of each key."""
    if table.num_rows < 2:
        return table
    return table.filter(pa.concat_arrays([pc.invert(_same(table, _KEY)), pa.array([True])]))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of one key in a batch the latest one."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        order = pc.sort_indices(rows, [(c, "ascending") for c in (*_KEY, "loaded_at", "digest")], null_placement="at_start")
        yield from _last_of_each(rows.take(order)).to_batches()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """The sorted rows with one row per key, and whether they are the last ones.

    Each table begins with the row that ended the one before.  A batch's last row waits for the next batch, which may
    have a later row of its key."""
    before = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = _last_of_each(rows if before is None else pa.concat_tables([before, rows]))
        if rows.num_rows > 2:
            yield rows.slice(0, rows.num_rows - 1), False
        before = rows.slice(max(rows.num_rows - 2, 0))
    if before is not None and before.num_rows:
        yield before, True


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [x.split()[0] for x in RESOLVED.split(", ")]
    for rows, last in _held(batches):
        yield from rows.select(columns).slice(0, rows.num_rows - (not last)).combine_chunks().to_batches()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two-pointer merge: each row is compared with the row behind it."""
    schema = pa.schema([("repo", pa.string()), ("snapshot_no", pa.int32()), ("path", pa.string()), ("change_kind", pa.string())])

    def typed(rows: pa.Table, which: pa.Array, number: str, kind: str) -> Iterator[pa.RecordBatch]:
        found = rows.filter(pc.fill_null(which, False))
        columns = [found.column("repo"), found.column(number), found.column("path"), pa.array([kind] * found.num_rows, pa.string())]
        yield from pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema).to_batches()

    first = True
    for rows, last in _held(batches):
        if first:
            yield from typed(rows.slice(0, 1), pc.greater(rows.column("ordinal").slice(0, 1), 1), "snapshot_no", "added")
            first = False
        if rows.num_rows > 1:
            one, two = rows.slice(0, rows.num_rows - 1).combine_chunks(), rows.slice(1).combine_chunks()
            follows = pc.and_(_same(rows, ["repo", "path"]), pc.equal(pc.add(one.column("ordinal"), 1), two.column("ordinal")).combine_chunks())
            yield from typed(one, pc.and_(pc.is_valid(one.column("next_no")), pc.invert(follows)), "next_no", "removed")
            yield from typed(two, pc.and_(pc.greater(two.column("ordinal"), 1), pc.invert(follows)), "snapshot_no", "added")
            yield from typed(two, pc.and_(follows, pc.not_equal(one.column("digest"), two.column("digest"))), "snapshot_no", "changed")
        if last:  # nothing is behind the last row
            end = rows.slice(rows.num_rows - 1)
            yield from typed(end, pc.is_valid(end.column("next_no")), "next_no", "removed")


def sorted_entries(entries: DataFrame) -> DataFrame:
    """The entries with ordinal and next_no of their snapshots, range-partitioned and sorted by key; the snapshots
    as they are kept.  Repeated rows of a key may still be there, the one that holds last."""
    rows = entries.select(
        "repo", plain_path(F.col("path")).alias("path"), F.col("snapshot_no").cast("int").alias("snapshot_no"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), known_hash(F.col("content_hash")).alias("digest")
    ).where("repo is not null and snapshot_no is not null and path <> ''")
    calendar = snapshot_calendar(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dated = rows.mapInArrow(_combine, ENTRIES).withColumn("salt", F.pmod(F.hash("path"), F.lit(SALTS))).join(calendar, ["repo", "salt"])
    ordinal = F.array_position("numbers", F.col("snapshot_no")).cast("int")
    numbered = dated.select("repo", "path", "snapshot_no", ordinal.alias("ordinal"), F.get("numbers", ordinal).cast("int").alias("next_no"), "loaded_at", "digest")
    return numbered.repartitionByRange("repo", "path").sortWithinPartitions(*_KEY, "loaded_at", "digest")


def resolve_entries(entries: DataFrame) -> DataFrame:
    """One row per (repo, snapshot_no, path): repo, path, snapshot_no, ordinal, next_no, digest.

    Of several rows the one with the latest ``loaded_at`` holds (null counts as the earliest); of rows
    loaded at the same time the one with the greatest known hash, so that the result doesn't depend on
    row order.  Rows without repo, snapshot_no or path have no identity and are left out.  Columns
    besides the five read here are ignored, whatever their names.
    """
    return sorted_entries(entries).mapInArrow(_resolve, RESOLVED)


def snapshot_changes(entries: DataFrame) -> DataFrame:
    """repo, snapshot_no, path, change_kind of each two consecutive snapshots of a repository.

    ``snapshot_no`` is the later snapshot's.  A path present on both sides is ``changed`` only if both
    hashes are known and differ.  A moved file is one ``removed`` and one ``added``.  A repository's
    first snapshot, an empty table and a single snapshot yield nothing.
    """
    return sorted_entries(entries).mapInArrow(_merge, CHANGES)


def change_counts(entries: DataFrame) -> DataFrame:
    """repo, snapshot_no, added, removed, changed: how many of each kind; snapshots without change are left out."""
    kinds = {k: F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "changed")}
    return snapshot_changes(entries).groupBy("repo", "snapshot_no").agg(*kinds.values())
