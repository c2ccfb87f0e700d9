"""Live journals equal their batch forms: micro-batches, disorder, repeated events, failures and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paramloom.sources.commits import Table
from paramloom.streaming import journal as J
from paramloom.streaming import live

EVENTS = "execution_id long, trial string, sequence long, kind string, ts timestamp, metric string, value double"
KINDS = ["trial_start", "step_completed", "step_completed", "step_failed", "trial_end"]


def events(spark, n=240, seed=3):
    rng = random.Random(seed)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)
    rows = []
    for k in range(n):
        kind = rng.choice(KINDS)
        rows.append((rng.choice([1, 1, 1, 2, 3]), rng.choice(["a", "b", None, "d"]), k, kind, at(k), rng.choice(["m", "n", None]) if kind == "step_completed" else None, rng.choice([None, float(k)])))
    return spark.createDataFrame(rows + rows[:20], EVENTS)


def feed(df, path, parts):
    """Files of the table in an order of their own."""
    for k in range(parts):
        df.where((F.col("sequence") * 7) % parts == k).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, df):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(df):
    return sorted(map(str, df.collect()))


def test_streamed_trials_equal_batch_after_a_failure(spark, tmp_path):
    df = events(spark)
    path, check = f"{tmp_path}/in", f"file://{tmp_path}/check"
    table = Table(spark, f"file://{tmp_path}/out")
    feed(df, path, 4)
    failing = Table(spark, table.path)
    calls = []

    def append(rows, writer):
        calls.append(writer[1])
        Table.append(failing, rows, writer)
        if len(calls) == 2:
            raise RuntimeError("lost after the commit, before the stream's own")

    failing.append = append
    with pytest.raises(Exception, match="lost after the commit"):
        live.into_table(live.trials(source(spark, path, df)), failing, "trials", check).awaitTermination()
    more = df.withColumn("sequence", F.col("sequence") + 1000).withColumn("kind", F.when(F.col("kind") == "step_failed", "step_completed").otherwise(F.col("kind")))
    feed(more, path, 2)
    live.into_table(live.trials(source(spark, path, df)), table, "trials", check).awaitTermination()
    assert calls == [0, 1] and table.snapshot().writers["trials"] >= 5 and table.snapshot().version <= 6
    got = table.read(["execution_id", "trial"])
    want = J.synthesize(df.unionByName(more))
    columns = ["execution_id", "trial", "status", "started_at", "completed_at", F.array_sort(F.map_entries("metrics")).alias("metrics")]
    # a null trial is a key like others in the stream; the batch join of metrics does not match it
    assert plain(got.where("trial is not null").select(columns)) == plain(want.where("trial is not null").select(columns))
    assert got.where("trial is null").count() == want.where("trial is null").count() > 0


def test_timers_close_trials(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [
        [(1, "a", 1, "trial_start", at(0), None, None), (1, "a", 2, "trial_end", at(5), None, None), (1, "b", 3, "trial_start", at(6), None, None)],
        [(1, "a", 4, "x", at(7), "m", 2.0), (2, "z", 1, "trial_start", at(40), None, None)],
        [(2, "z", 2, "trial_end", at(41), None, None), (1, "a", 9, "trial_end", at(60), None, None)],
    ]
    path, table = f"{tmp_path}/in", Table(spark, f"file://{tmp_path}/out")
    for b in batches:
        df = spark.createDataFrame(b, EVENTS)
        df.coalesce(1).write.mode("append").parquet(path)
        live.into_table(live.trials(source(spark, path, df), grace="10 minutes"), table, "trials", f"file://{tmp_path}/check").awaitTermination()
    got = {(r["trial"], r["closed"], r["completed_at"].minute): r for r in table.read([]).collect()}
    assert got["a", True, 5]["metrics"] == {"m": 2.0} and got["a", True, 5]["started_at"].minute == 0
    assert got["a", False, 0]["started_at"] is None  # begun anew after it was closed
    assert ("z", False, 41) in got and not any(k[0] == "b" for k in got)


def test_streamed_recovery_with_restarts(spark, tmp_path):
    df = events(spark).select("execution_id", F.col("trial").alias("step_id"), "sequence", F.element_at(F.array(*map(F.lit, ["step_started", "step_completed", "step_failed", "step_skipped", "execution_paused"])), (F.col("sequence") % 5 + 1).cast("int")).alias("kind"))
    path, table = f"{tmp_path}/in", Table(spark, f"file://{tmp_path}/out")
    for k in range(3):
        feed(df.where(F.col("sequence") % 3 == k), path, 2)
        live.into_table(live.live_recovery(source(spark, path, df)), table, "recovery", f"file://{tmp_path}/check").awaitTermination()
    columns = ["execution_id", "step_id", "completed", "failed", "skipped", "in_flight"]
    assert plain(table.read(["execution_id", "step_id"]).select(columns)) == plain(J.recovery(df).select(columns))


def test_subscription_starts_from_now_and_says_what_it_lost(spark, tmp_path):
    schema = "execution_id long, sequence long, kind string, step_id string, ts timestamp"
    row = lambda e, k: (e, k, "step_started", None if k % 2 else f"s{k}", dt.datetime(2024, 1, 1))
    path, table = f"{tmp_path}/in", Table(spark, f"file://{tmp_path}/out")
    seen = spark.createDataFrame([(1, 3), (7, 1)], "execution_id long, sequence long")
    batches = [[row(1, k) for k in (2, 3, 5, 4)] + [row(2, k) for k in range(20, 8, -1)], [row(1, 5), row(1, 6), row(1, 6)] + [row(2, k) for k in range(21, 24)]]
    for b in batches:
        df = spark.createDataFrame(b, schema)
        df.coalesce(1).write.mode("append").parquet(path)
        live.into_table(live.subscribe(source(spark, path, df), buffer=5, seen=seen), table, "feed", f"file://{tmp_path}/check", "append").awaitTermination()
    got = [(r["execution_id"], r["sequence"], r["lagged"]) for r in table.read([]).collect()]
    assert sorted(got, key=str) == sorted([(1, 4, None), (1, 5, None), (1, 6, None), (2, 16, 7), *[(2, k, None) for k in range(16, 24)]], key=str)
