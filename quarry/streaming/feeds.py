"""Streams: windows over events, deduplication by content, a change feed, and a stateful session count."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.operators import changes
from quarry.sources.tables import ensure_checkpoint_dir


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone; ours have none and are UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of tumbling or sliding windows; streams drop events later than ``late``."""
    timed = event_time(events)
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, n of sessions that end after a gap."""
    timed = event_time(events)
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once; a stream remembers keys only within the watermark."""
    timed = event_time(events)
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)


def change_feed(entries: DataFrame, previous: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A stream writer that holds each micro-batch of manifest entries (path, content_hash, loaded_at) against the
    last version, and hands the changes of the batch's own paths to ``sink``.  Start it with ``.start()``."""

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by("content_hash", F.struct("loaded_at", "content_hash")).alias("content_hash"))
        known = previous().join(latest.select("path"), "path", "left_semi")
        sink(changes.diff(known, latest), number)

    return entries.writeStream.foreachBatch(each)


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total after each micro-batch, by a custom stateful operator that holds two numbers a user."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All of a bounded stream, as a table of Parquet files in the shared folder: of ``complete`` the last result, else
    what all micro-batches gave.  A micro-batch that is run again replaces its own files."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).queryName(name).foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", IntegerType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def replay(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A Parquet table, one file or many, as a stream."""
    path = f"{folder}/{table}.parquet"
    rows = spark.read.parquet(path)
    single = any(f.endswith(f"/{table}.parquet") for f in rows.inputFiles()[:1])
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{table}.parquet" if single else "*.parquet").parquet(folder if single else path)
