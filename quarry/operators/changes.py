"""What changed between the last published manifest and the current files, and what can be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.operators.search import running
from quarry.sources.tables import cut


def rename_pairs(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """old_path, new_path, content_hash: the k-th deleted path of a hash with its k-th new path, both in path
    order.  Empty and null hashes never pair.

    The numbers come from prefix sums in two levels, so a hash that very many moved files share lies in many tasks.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("content_hash <> ''").select("content_hash", "path", F.lit(0).alias("none"))
        return running(rows, "content_hash", ["path"], "none").select("content_hash", F.col("path").alias(name), F.col("position").alias("k"))

    return numbered(deleted, "old_path").join(numbered(added, "new_path"), ["content_hash", "k"]).select("old_path", "new_path", "content_hash")


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, kind, old_path of every path on either side; kind is NEW, CHANGED, DELETED, UNCHANGED or RENAMED.

    Inputs have path and content_hash, one row per path.  A byte-identical move is one RENAMED row that
    carries its old path.  A path with a null or empty hash on one side counts as changed.
    """
    p, c = previous.select("path", F.col("content_hash").alias("old_hash")), current.select("path", F.col("content_hash").alias("new_hash"))
    both = p.withColumn("was", F.lit(True)).join(c.withColumn("is", F.lit(True)), "path", "full_outer")
    same = F.coalesce((F.col("old_hash") == F.col("new_hash")) & (F.col("old_hash") != ""), F.lit(False))
    kind = F.when(F.col("was").isNull(), "NEW").when(F.col("is").isNull(), "DELETED").when(same, "UNCHANGED").otherwise("CHANGED")
    sided = cut(both.select("path", kind.alias("kind"), "old_hash", "new_hash"))
    renames = rename_pairs(sided.where("kind = 'DELETED'").select("path", F.col("old_hash").alias("content_hash")), sided.where("kind = 'NEW'").select("path", F.col("new_hash").alias("content_hash")))
    # one small table says of a path that it is new by a move, or gone by one; only new and deleted paths can be in it
    moves = renames.select(F.explode(F.array(F.struct(F.col("new_path").alias("path"), F.col("old_path").alias("old_path")), F.struct(F.col("old_path").alias("path"), F.lit(None).cast("string").alias("old_path")))).alias("m")).select("m.*", F.lit(True).alias("moved"))
    once = sided.where("kind in ('NEW', 'DELETED')").join(moves, "path", "left")
    once = once.where("not (kind = 'DELETED' and moved is not null)").select("path", F.when(F.col("old_path").isNotNull(), "RENAMED").otherwise(F.col("kind")).alias("kind"), "old_path")
    return once.unionByName(sided.where("kind not in ('NEW', 'DELETED')").select("path", "kind", F.lit(None).cast("string").alias("old_path")))


def statistics(changes: DataFrame) -> DataFrame:
    """One row: new, changed, deleted, renamed, unchanged, scheduled (what has to be parsed)."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return changes.agg(count("NEW").alias("new"), count("CHANGED").alias("changed"), count("DELETED").alias("deleted"), count("RENAMED").alias("renamed"), count("UNCHANGED").alias("unchanged"), count("NEW", "CHANGED", "RENAMED").alias("scheduled"))


def scheduled_paths(changes: DataFrame) -> DataFrame:
    """The paths to parse: new, changed and renamed."""
    return changes.where(F.col("kind").isin("NEW", "CHANGED", "RENAMED")).select("path")


def reuse_plan(changes: DataFrame, records: DataFrame, previous_records: DataFrame) -> DataFrame:
    """path, decision, and the parse outcome that a reused file carries over from its previous record.

    ``decision`` is PARSE (scheduled, or nothing to reuse), or REUSE (unchanged and recorded before).
    """
    before = previous_records.select("path", F.col("parse_status").alias("old_status"), F.col("parse_error").alias("old_error"), F.col("node_count").alias("old_nodes"), F.col("max_depth").alias("old_depth"), F.lit(True).alias("recorded"))
    joined = records.select("path", "parse_status", "parse_error", "node_count", "max_depth").join(changes.select("path", "kind"), "path").join(before, "path", "left")
    reuse = (F.col("kind") == "UNCHANGED") & F.col("recorded").isNotNull()
    pick = lambda old, new: F.when(reuse, F.col(old)).otherwise(F.col(new)).alias(new)
    return joined.select("path", F.when(reuse, "REUSE").otherwise("PARSE").alias("decision"), pick("old_status", "parse_status"), pick("old_error", "parse_error"), pick("old_nodes", "node_count"), pick("old_depth", "max_depth"))


def restamp(entities: DataFrame, version) -> DataFrame:
    """Reused rows under a new model version; every other column stays."""
    return entities.withColumn("model_version", version)
