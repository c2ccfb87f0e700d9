"""Journals: replay, recovery and trial synthesis in batch, and the same folds over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retention import first_wins, latest

TERMINAL = ("step_completed", "step_failed", "step_skipped")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent: of a repeated (execution_id, sequence) the one that is already there stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_wins(both, ["execution_id", "sequence"], "_new").drop("_new")


def replay(journal: DataFrame, after: int | None = None) -> DataFrame:
    return journal if after is None else journal.where(F.col("sequence") > after)


def truncate(journal: DataFrame, before: int) -> DataFrame:
    return journal.where(F.col("sequence") >= before)


def last_event(journal: DataFrame) -> DataFrame:
    return latest(journal, ["execution_id"], "sequence")


def last_overall(journal: DataFrame) -> DataFrame:
    """The event with the largest sequence of all executions (of equals the largest execution)."""
    return journal.orderBy(F.desc("sequence"), F.desc("execution_id")).limit(1)


def delete_all(journal: DataFrame, executions: DataFrame) -> DataFrame:
    """The journal without the given executions."""
    return journal.join(executions.select("execution_id").distinct(), "execution_id", "left_anti")


def is_completed(journal: DataFrame, steps: DataFrame) -> DataFrame:
    """steps (execution_id, step_id) with `completed`: whether any such event is in the journal."""
    done = journal.where("kind = 'step_completed'").select("execution_id", "step_id").distinct().withColumn("_done", F.lit(True))
    return steps.join(done, ["execution_id", "step_id"], "left").select(*steps.columns, F.coalesce("_done", F.lit(False)).alias("completed"))


def latest_sequence(journal: DataFrame, executions: DataFrame) -> DataFrame:
    top = journal.groupBy("execution_id").agg(F.max("sequence").alias("s"))
    return executions.select("execution_id").distinct().join(top, "execution_id", "left").select("execution_id", F.coalesce("s", F.lit(0)).alias("sequence"))


def recovery(journal: DataFrame) -> DataFrame:
    """Per execution and step: completed, failed, skipped (not exclusive), in_flight; one aggregation, no ordering."""
    at = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("sequence")))
    steps = journal.where("step_id is not null").groupBy("execution_id", "step_id").agg(
        at("step_completed").alias("c"), at("step_failed").alias("f"), at("step_skipped").alias("s"), at("step_started").alias("b"), at(*TERMINAL).alias("t")
    )
    return steps.select("execution_id", "step_id", F.col("c").isNotNull().alias("completed"), F.col("f").isNotNull().alias("failed"), F.col("s").isNotNull().alias("skipped"), (F.col("b").isNotNull() & (F.col("t").isNull() | (F.col("b") > F.col("t")))).alias("in_flight"))


def step_statistics(journal: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return journal.where("step_id is not null").groupBy("step_id").agg(n("step_started").alias("attempts"), n("step_completed").alias("successes"), n("step_failed").alias("failures"), n("step_skipped").alias("skips"))


def synthesize(events: DataFrame) -> DataFrame:
    """Trial results of closed sessions: events (execution_id, trial, sequence, kind, ts, metric, value).

    The first trial_start, the trial_end that closes, any failure, and the last write of each metric.
    """
    runs = events.groupBy("execution_id", "trial").agg(
        F.min(F.when(F.col("kind") == "trial_start", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("kind") == "trial_end", F.col("ts"))).alias("completed_at"),
        F.bool_or(F.col("kind") == "step_failed").alias("bad"), F.bool_or(F.col("kind") == "trial_end").alias("ended"),
    ).where("ended")
    metrics = events.where("metric is not null").groupBy("execution_id", "trial", "metric").agg(F.max_by("value", "sequence").alias("value"))
    metrics = metrics.groupBy("execution_id", "trial").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return runs.join(metrics, ["execution_id", "trial"], "left").select("execution_id", "trial", F.when(F.col("bad"), "failed").otherwise("completed").alias("status"), "started_at", "completed_at", "metrics")


def stream_recovery(journal_stream: DataFrame, name: str):
    """A running recovery table of a journal stream (complete mode; state is one row per execution and step)."""
    return recovery(journal_stream).writeStream.outputMode("complete").format("memory").queryName(name)


def stream_deduplicated(journal_stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (execution_id, sequence) once, within a bounded delay."""
    return journal_stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["execution_id", "sequence"])


def stream_windows(journal_stream: DataFrame, delay: str = "10 minutes", width: str = "15 minutes") -> DataFrame:
    """Events by kind in tumbling windows."""
    return journal_stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("events"))


def tail(spark, path: str, schema, since: int | None = None) -> DataFrame:
    """A live journal from a folder of Parquet files; nothing is lost when a reader lags."""
    return replay(spark.readStream.schema(schema).parquet(path), since)
