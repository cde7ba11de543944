from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.streaming import feeds

T = datetime(2024, 1, 1, 10)


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_stream_equals_batch(spark, tmp_path):
    folder = write(spark, tmp_path, [(i, T + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(40)] + [(1, T + timedelta(minutes=7), 1, "b", 1.0)])
    batch = spark.read.parquet(folder + "/events.parquet")
    stream = feeds.run_to_end(feeds.windowed(feeds.replay(spark, folder, "events"), "1 hour"), "t_tumbling", "complete")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, feeds.windowed(batch, "1 hour").collect()))
    once = feeds.run_to_end(feeds.distinct_events(feeds.replay(spark, folder, "events"), ["event_id"], "30 days").select("event_id"), "t_dedupe")
    assert once.count() == 40
    totals = feeds.run_to_end(feeds.running_totals(feeds.event_time(feeds.replay(spark, folder, "events"))), "t_totals", "update")
    assert {r.user_id: r.n for r in totals.groupBy("user_id").agg(F.max("n").alias("n")).collect()} == {0: 14, 1: 14, 2: 13}
    assert feeds.sessions(batch, "10 minutes").count() > 0


def test_change_feed(spark, tmp_path):
    spark.createDataFrame([("a", "2", T), ("b", "1", T)], "path string, content_hash string, loaded_at timestamp").write.parquet(str(tmp_path / "landing"))
    known = spark.createDataFrame([("a", "1"), ("z", "1")], "path string, content_hash string")
    seen = []
    rows = spark.readStream.schema("path string, content_hash string, loaded_at timestamp").parquet(str(tmp_path / "landing"))
    q = feeds.change_feed(rows, lambda: known, lambda df, n: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [("a", "CHANGED", None), ("b", "NEW", None)]
