"""Parquet sources and sinks shared by every query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one file or a directory of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, which ``spark.checkpoint.dir`` names.

    Where that setting is missing, a temporary folder takes its place only if all tasks run on this machine; on a
    cluster, whose machines don't share such a folder, this raises ValueError.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """``df`` over all cores if its source has fewer splits than there are cores, as one small file has.

    For rows that much computing awaits.  A source of enough splits, as any large one, is left alone: its
    rows don't move.  ``df`` has to be a scan with projections and filters, whose splits can be counted
    without running anything.  ``ordered`` sorts rows that were moved by ``key``: what is computed of a partition's
    order then stays the same if a task is run again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    if splits >= cores:
        return df
    moved = df.repartition(cores, key)
    return moved.sortWithinPartitions(key) if ordered else moved
