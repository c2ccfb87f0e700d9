"""Live journals: recovery, trial synthesis and subscriptions as running streams over tables of commits.

* Recovery is a streaming aggregation by execution and step: built-in functions, one row of state a step.
* Trial synthesis is keyed state by execution and trial (start, end, failure, last write of each metric), put out whenever
  it changes once the trial has ended; with a grace time, an event-time timer puts it out for the last time and drops the
  state.
  For journals of many trials trial_parts() keeps the same by trial and metric in built-in aggregates; trial_results()
  puts the parts together when the table is read.
* A subscription is keyed state by execution: the last sequence that was given out. It starts from now (or from the
  sequences it is handed), gives events in order and once, and if more than `buffer` events of an execution are waiting,
  drops the oldest and says how many, as a row of its own.

A hot execution's steps and trials are keys of their own; only a subscription handles an execution in one place, holding
`buffer` events of it at most. Sinks are tables of commits: each micro-batch is one commit under the stream's name and
number, so a batch that is repeated after a failure is in the table once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.commits import Table
from .journal import recovery

BUFFER = 1024
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRIALS = "execution_id long, trial string, status string, started_at timestamp, completed_at timestamp, metrics map<string,double>, closed boolean"
FEED = "execution_id long, sequence long, kind string, step_id string, ts timestamp, lagged long"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider; a session that names another keeps its name until this is called."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Trial(StatefulProcessor):
    """The result of one trial as its events come, in whatever order."""

    def __init__(self, grace_ms: int | None) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "started timestamp, ended timestamp, failed boolean")
        self.metrics = handle.getMapState("metrics", "metric string", "value double, sequence long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, ended, failed = self.head.get() if self.head.exists() else (None, None, False)
        was, written = ended, {}
        for part in rows:
            for kind, ts, metric, value, sequence in zip(*(part[c] for c in ("kind", "ts", "metric", "value", "sequence"))):
                if kind == "trial_start":
                    started = ts if started is None else min(started, ts)
                elif kind == "trial_end":
                    ended = ts if ended is None else max(ended, ts)
                elif kind == "step_failed":
                    failed = True
                if not pd.isna(metric) and (metric not in written or written[metric][1] <= sequence):
                    written[metric] = (None if pd.isna(value) else float(value), int(sequence))
        for metric, (value, sequence) in written.items():
            if not self.metrics.containsKey((metric,)) or self.metrics.getValue((metric,))[1] <= sequence:
                self.metrics.updateValue((metric,), (value, sequence))
        self.head.update((started, ended, failed))
        if ended is None:
            return
        if self.grace_ms is not None and ended != was:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(ended).timestamp() * 1000) + self.grace_ms)
        yield self._row(key, started, ended, failed, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, *self.head.get(), True)
        self.head.clear()
        self.metrics.clear()

    def _row(self, key, started, ended, failed: bool, closed: bool) -> pd.DataFrame:
        metrics = {k[0]: v[0] for k, v in self.metrics.iterator()} or None
        return pd.DataFrame({"execution_id": [key[0]], "trial": [key[1]], "status": ["failed" if failed else "completed"], "started_at": [pd.Timestamp(started) if started is not None else pd.NaT], "completed_at": [pd.Timestamp(ended)], "metrics": [metrics], "closed": [closed]})

    def close(self) -> None:
        pass


def trials(events: DataFrame, grace: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Results of ended trials as a stream of changes: events (execution_id, trial, sequence, kind, ts, metric, value).

    The last row of a trial is what synthesize() gives for its events. With grace ("10 minutes"), a trial's state goes once
    the watermark (delay behind the latest event) is so far past its end; its last row then says `closed`, and later
    events begin it anew. Without, state stays as long as the stream."""
    keyed = events.select("execution_id", "trial", "sequence", "kind", "ts", "metric", "value")
    if grace is None:
        return keyed.groupBy("execution_id", "trial").transformWithStateInPandas(_Trial(None), TRIALS, "Update", "None")
    grace_ms = int(pd.Timedelta(grace).total_seconds() * 1000)
    return keyed.withWatermark("ts", delay).groupBy("execution_id", "trial").transformWithStateInPandas(_Trial(grace_ms), TRIALS, "Update", "EventTime")


def trial_parts(events: DataFrame) -> DataFrame:
    """A stream of what is known of each trial by metric (null: events without one), from built-in aggregates: state is one
    row an execution, trial and metric, and nothing of a trial goes through Python. trial_results() puts the last row of
    each part together."""
    at = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    write = F.when(F.col("metric").isNotNull(), F.struct("sequence", "value"))
    return events.groupBy("execution_id", "trial", "metric").agg(
        F.min(at("trial_start", "ts")).alias("started_at"), F.max(at("trial_end", "ts")).alias("completed_at"), F.coalesce(F.bool_or(F.col("kind") == "step_failed"), F.lit(False)).alias("failed"), F.max(write)["value"].alias("value")
    )


def trial_results(parts: DataFrame) -> DataFrame:
    """Ended trials, as synthesize() gives them, from the last row of each part: a table of trial_parts() read by
    execution_id, trial and metric. A null trial is a key like others."""
    entry = F.when(F.col("metric").isNotNull(), F.struct("metric", "value"))
    whole = parts.groupBy("execution_id", "trial").agg(F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.bool_or("failed").alias("failed"), F.array_sort(F.collect_list(entry)).alias("_metrics"))
    metrics = F.when(F.size("_metrics") > 0, F.map_from_entries("_metrics")).alias("metrics")
    return whole.where("completed_at is not null").select("execution_id", "trial", F.when(F.col("failed"), "failed").otherwise("completed").alias("status"), "started_at", "completed_at", metrics)


class _Feed(StatefulProcessor):
    """The events of one execution in order, each once."""

    def __init__(self, buffer: int | None) -> None:
        self.buffer = buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["sequence"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        last = None if state is None else state[0]
        waiting: list[tuple] = []  # a heap: the oldest goes first
        held, dropped = set(), 0
        for part in rows:
            for sequence, kind, step, ts in zip(*(part[c] for c in ("sequence", "kind", "step_id", "ts"))):
                if (last is not None and sequence <= last) or sequence in held:
                    continue
                held.add(sequence)
                heapq.heappush(waiting, (int(sequence), kind, None if pd.isna(step) else step, ts))
                if self.buffer is not None and len(waiting) > self.buffer:
                    held.discard(heapq.heappop(waiting)[0])
                    dropped += 1
        if not waiting:
            return
        waiting.sort(key=lambda e: e[0])
        self.last.update((waiting[-1][0],))
        if dropped:
            waiting.insert(0, (waiting[0][0], None, None, pd.NaT))
        sequences, kinds, steps, times = zip(*waiting)
        lagged = pd.array([dropped if dropped and not i else None for i in range(len(waiting))], dtype="Int64")
        yield pd.DataFrame({"execution_id": key[0], "sequence": sequences, "kind": kinds, "step_id": steps, "ts": pd.DatetimeIndex(times), "lagged": lagged})

    def close(self) -> None:
        pass


def subscribe(journal: DataFrame, buffer: int | None = BUFFER, seen: DataFrame | None = None) -> DataFrame:
    """A live feed of journal (execution_id, sequence, kind, step_id, ts): each execution's events in order, once.

    seen (execution_id, sequence): what each execution had when the subscriber came; only later events are given. Of more
    than `buffer` events of an execution in one micro-batch the oldest are dropped: a row with `lagged`, their number, and
    the sequence that follows them comes first. buffer=None drops none and sorts a micro-batch's events of an execution in
    memory. Event rows have no `lagged`."""
    keyed = journal.select("execution_id", F.col("sequence").cast("long").alias("sequence"), "kind", "step_id", "ts").groupBy("execution_id")
    start = None if seen is None else seen.select("execution_id", F.col("sequence").cast("long").alias("sequence")).groupBy("execution_id")
    return keyed.transformWithStateInPandas(_Feed(buffer), FEED, "Append", "None", start)


def into_table(stream: DataFrame, table: Table, name: str, checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Run a stream into a table of commits; once: all that is there, then stop. Restarts go on from the checkpoint."""
    use_state_store(stream.sparkSession)

    def add(batch: DataFrame, number: int) -> None:
        if table.snapshot().writers.get(name, -1) >= number:
            batch.write.format("noop").mode("overwrite").save()  # it is in; its state must be worked out all the same
        else:
            table.append(batch, writer=(name, number))

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def live_recovery(journal: DataFrame) -> DataFrame:
    """recovery() as a stream of changed rows."""
    return recovery(journal)
