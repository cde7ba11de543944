from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.operators import changes
from quarry.operators.snapshot_diff import resolve_entries, snapshot_changes, sorted_entries

SCHEMA = "repo string, snapshot_no int, path string, content_hash string, loaded_at timestamp_ntz, taken_at timestamp_ntz, digest string, ordinal int"
T = datetime(2024, 1, 1)


def entries(spark, rows):
    return spark.createDataFrame([(*r, T, "clash", 7) for r in rows], SCHEMA)


def found(spark, rows):
    return {tuple(r) for r in snapshot_changes(entries(spark, rows)).collect()}


def brute(rows):
    held = {}
    for repo, no, path, h, at in rows:
        if repo is None or no is None or path is None:
            continue
        while "//" in path.replace("\\", "/"):
            path = path.replace("\\", "/").replace("//", "/")
        path = path.replace("\\", "/")
        while path.startswith("./"):
            path = path[2:]
        d = (h or "").strip().lower().removeprefix("sha256:").strip() or None
        key = (at or datetime.min, d or "")
        if path and ((repo, no, path) not in held or key > held[repo, no, path][0]):
            held[repo, no, path] = (key, d)
    out = set()
    for repo in {r[0] for r in rows if r[0] is not None}:
        numbers = sorted({r[1] for r in rows if r[0] == repo and r[1] is not None})
        for a, b in zip(numbers, numbers[1:]):
            old = {k[2]: v[1] for k, v in held.items() if k[:2] == (repo, a)}
            new = {k[2]: v[1] for k, v in held.items() if k[:2] == (repo, b)}
            out |= {(repo, b, p, "added") for p in new.keys() - old.keys()} | {(repo, b, p, "removed") for p in old.keys() - new.keys()}
            out |= {(repo, b, p, "changed") for p in new.keys() & old.keys() if old[p] and new[p] and old[p] != new[p]}
    return out


def test_snapshot_changes(spark):
    rows = [
        ("r", 1, "a", "sha256:AA", T), ("r", 1, "./a", "aa", T), ("r", 1, "b", "1", T), ("r", 1, "gone", "1", T), ("r", 1, "x\\y", "1", T),
        ("r", 4, "a", "sha256:aa", T), ("r", 4, "b", None, T), ("r", 4, "b", "2", T - timedelta(1)), ("r", 4, "new", "", T), ("r", 4, "x//y", "2", T), ("r", 4, "A", "1", T),
        ("r", 5, "b", "3", T), ("r", 5, None, "3", T), ("one", 1, "a", "1", T), (None, 1, "a", "1", T),
    ]
    assert found(spark, rows) == brute(rows)
    assert ("r", 4, "x/y", "changed") in found(spark, rows) and not any(r[0] == "one" for r in found(spark, rows))


def test_snapshots_that_lose_every_path(spark):
    rows = [("r", 1, "a", "1", T), ("r", 2, None, "1", T), ("r", 3, "a", "1", T)]
    assert found(spark, rows) == brute(rows) == {("r", 2, "a", "removed"), ("r", 3, "a", "added")}


def test_empty_and_repeated(spark):
    assert found(spark, []) == set()
    rows = [("r", 1, "a", "1", None), ("r", 2, "a", "2", None)] * 50
    assert found(spark, rows) == {("r", 2, "a", "changed")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["r", "s"]), st.integers(1, 4), st.sampled_from(["a", "./a", "b\\c", "b//c", "d"]), st.sampled_from(["1", "SHA256:1", "2", "", None]), st.sampled_from([T, T + timedelta(1), None])), max_size=25))
def test_merge_equals_set_differences(spark, rows):
    assert found(spark, rows) == brute(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["r", "s"]), st.integers(1, 4), st.sampled_from(["a", "./a", "b", "d"]), st.sampled_from(["1", "2", None]), st.sampled_from([T, T + timedelta(1), None])), max_size=25), st.integers(1, 4))
def test_merge_over_small_batches(spark, rows, size):
    """A key's rows are divided over batches anywhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert found(spark, rows) == brute(rows)
        kept = [tuple(r) for r in resolve_entries(entries(spark, rows)).select("repo", "snapshot_no", "path").collect()]
        assert len(kept) == len(set(kept))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_key_with_very_many_rows(spark):
    """A hot key's rows are combined batch by batch before they are shuffled."""
    hot = spark.range(60_000).select(F.lit("r").alias("repo"), (F.col("id") % 2 + 1).cast("int").alias("snapshot_no"), F.lit("a").alias("path"), F.col("id").cast("string").alias("content_hash"), (F.lit(T) + F.make_dt_interval(secs=F.col("id").cast("int"))).cast("timestamp_ntz").alias("loaded_at"))
    assert sorted_entries(hot).count() <= 40
    assert [tuple(r) for r in snapshot_changes(hot).collect()] == [("r", 2, "a", "changed")]


def manifest(spark, d):
    return spark.createDataFrame(list(d.items()), "path string, content_hash string")


def test_diff_kinds_and_renames(spark):
    old = manifest(spark, {"same": "1", "edit": "2", "gone": "3", "m1": "9", "m2": "9", "u": ""})
    new = manifest(spark, {"same": "1", "edit": "5", "fresh": "4", "n2": "9", "n1": "9", "n3": "9", "u": ""})
    got = {r.path: (r.kind, r.old_path) for r in changes.diff(old, new).collect()}
    assert got == {"same": ("UNCHANGED", None), "edit": ("CHANGED", None), "gone": ("DELETED", None), "fresh": ("NEW", None), "n1": ("RENAMED", "m1"), "n2": ("RENAMED", "m2"), "n3": ("NEW", None), "u": ("CHANGED", None)}
    assert changes.statistics(changes.diff(old, new)).first().asDict() == {"new": 2, "changed": 2, "deleted": 1, "renamed": 2, "unchanged": 1, "scheduled": 6}
    assert changes.diff(old.limit(0), new.limit(0)).count() == 0


def test_reuse_carries_the_outcome(spark):
    cols = "path string, parse_status string, parse_error string, node_count int, max_depth int"
    now = spark.createDataFrame([("a", "OK", None, 0, 0), ("b", "OK", None, 0, 0), ("c", "OK", None, 0, 0)], cols)
    old = spark.createDataFrame([("a", "PARTIAL", "e", 5, 2), ("b", "OK", None, 7, 3)], cols)
    delta = spark.createDataFrame([("a", "UNCHANGED", None), ("b", "CHANGED", None), ("c", "UNCHANGED", None)], "path string, kind string, old_path string")
    got = {r.path: (r.decision, r.parse_status, r.node_count) for r in changes.reuse_plan(delta, now, old).collect()}
    assert got == {"a": ("REUSE", "PARTIAL", 5), "b": ("PARSE", "OK", 0), "c": ("PARSE", "OK", 0)}
    assert changes.restamp(old, F.lit("v")).select("model_version").distinct().count() == 1
