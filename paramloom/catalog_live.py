"""Queries over running streams and tables of commits, with the SQL that states their results."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from .catalog import _sessions, query
from .sources import views as V
from .sources.commits import Table
from .sources.shared import new_folder, written
from .streaming import kinds, live

# ---- streams: the journal arrives in three slices of time; after each the stream is started anew from its checkpoint ----

SLICES = 3


def _slices(journal):
    """journal with `slice`: which third of its time span an event lies in."""
    journal = journal.withColumn("ts", F.col("ts").cast("timestamp"))
    span = journal.agg(F.min(F.unix_micros("ts")).alias("_low"), F.max(F.unix_micros("ts")).alias("_high"))
    part = F.expr(f"(unix_micros(ts) - _low) * {SLICES} div (_high - _low + 1)")
    return journal.crossJoin(span).withColumn("slice", part.cast("int")).drop("_low", "_high")  # span is a single row


def _streamed(journal, name, make, mode="update"):
    """The table that make(stream) leaves after all slices."""
    spark = journal.sparkSession
    sliced = written(_slices(journal), "slices")
    feed, table, check = new_folder(spark, "feed"), Table(spark, new_folder(spark, "live")), new_folder(spark, "check")
    for k in range(SLICES):
        sliced.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(feed)
        stream = spark.readStream.schema(sliced.drop("slice").schema).parquet(feed)
        live.into_table(make(stream), table, name, check, mode).awaitTermination()
    return table


@query(
    "live_trial_synthesis",
    "SELECT execution_id, step_id AS trial, CASE WHEN bool_or(kind = 'step_failed') THEN 'failed' ELSE 'completed' END AS status, min(ts) FILTER (kind = 'execution_started') AS started_at, max(ts) FILTER (kind = 'step_skipped') AS completed_at, arg_max(value, sequence) FILTER (kind = 'step_completed') AS last_value FROM journal GROUP BY 1, 2 HAVING bool_or(kind = 'step_skipped')",
)
def live_trial_synthesis(s, d):
    table = _streamed(_sessions(s, d), "trials", live.trial_parts)
    got = live.trial_results(table.read(["execution_id", "trial", "metric"]))
    return got.select("execution_id", "trial", "status", F.col("started_at").cast("timestamp_ntz"), F.col("completed_at").cast("timestamp_ntz"), F.col("metrics")["value"].alias("last_value"))


@query(
    "live_journal_recovery",
    "SELECT execution_id, step_id, bool_or(kind = 'step_completed') AS completed, bool_or(kind = 'step_failed') AS failed, bool_or(kind = 'step_skipped') AS skipped, coalesce(max(sequence) FILTER (kind = 'step_started') > coalesce(max(sequence) FILTER (kind IN ('step_completed', 'step_failed', 'step_skipped')), -1), false) AS in_flight FROM journal GROUP BY 1, 2",
)
def live_journal_recovery(s, d):
    return _streamed(V.journal(s, d), "recovery", live.live_recovery).read(["execution_id", "step_id"])


@query(
    "live_subscription",
    ", span AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM journal), cut AS (SELECT execution_id, CAST(sequence AS BIGINT) AS sequence, kind, step_id, (epoch_us(ts) - low) * 3 // (high - low + 1) AS slice FROM journal, span),"
    " late AS (SELECT *, row_number() OVER (PARTITION BY execution_id, slice ORDER BY sequence DESC) AS back, count(*) OVER (PARTITION BY execution_id, slice) AS n FROM cut WHERE slice > 0)"
    " SELECT execution_id, sequence, kind, step_id, CAST(NULL AS BIGINT) AS lagged FROM late WHERE back <= 8 UNION ALL SELECT execution_id, sequence, NULL, NULL, n - 8 FROM late WHERE back = 8 AND n > 8",
)
def live_subscription(s, d):
    """A subscriber that comes when the first slice is there; of more than 8 waiting events it is told how many it lost."""
    journal = V.journal(s, d).select("execution_id", "sequence", "kind", "step_id", "ts")
    seen = written(_slices(journal).where("slice = 0").groupBy("execution_id").agg(F.max("sequence").alias("sequence")), "seen")
    feed = lambda stream: live.subscribe(stream, buffer=8, seen=seen)
    return _streamed(journal, "feed", feed, "append").read([]).select("execution_id", "sequence", "kind", "step_id", "lagged")


# ---- event kinds and payloads --------------------------------------------------------------------------------------

_ORDER = list(kinds.KINDS)
_TYPES = ["signup", "view", "click", "error", "purchase"]
_EVENT = (
    "WITH e AS (SELECT event_id, user_id AS execution_id, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS t FROM events), "
    "j AS (SELECT *, CASE t * 3 + k % 3 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_ORDER)) + " END AS kind FROM e) "
)
#: each field's value from k, the number in an event's props, and from its value
_VALUES = {
    "plan_fingerprint": "'plan-' || k", "checkpoint_id": "'check-' || k % 9", "reason": "CASE WHEN k % 4 > 0 THEN 'because of ' || k ELSE '' END", "graceful": "k % 2 = 0", "success": "value > 20",
    "duration": "value", "step_id": "'step-' || k", "attempt": "CAST(1 + k % 5 AS INTEGER)", "error": None, "instance_id": "'node-' || k % 7", "from": "'idle'", "to": "CASE WHEN k > 50 THEN 'busy' ELSE 'idle' END",
    "barrier_id": "'wall-' || k", "waited": "value / 2", "completed_step_count": "CAST(k * 3 AS INTEGER)", "trial_id": "'trial-' || k", "trial_index": "CAST(k AS INTEGER)", "status": "CASE WHEN k % 3 = 2 THEN 'failed' ELSE 'completed' END",
}


def _kinds(s, d):
    """A journal of all fifteen kinds, its payloads as they are stored: VARIANT columns in Parquet."""
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")) - 1
    e = V.table(s, d, "events").select("event_id", F.col("user_id").alias("execution_id"), "ts", "value", k.alias("k"), F.get(F.array(*map(F.lit, _ORDER)), (t * 3 + k % 3).cast("int")).alias("kind"))
    error = F.struct(F.when(F.col("k") % 2 == 0, "timeout").otherwise("crash").alias("kind"), F.concat(F.lit("no. "), F.col("k").cast("string")).alias("message"))
    value = {n: error if n == "error" else F.expr(v) for n, v in _VALUES.items()}
    given = {n: F.when(F.col("kind").isin([q for q, fields in kinds.KINDS.items() if n in fields]), v) for n, v in value.items()}
    return e.select("event_id", "execution_id", "ts", "k", "kind", kinds.payload(given).alias("payload"))


_HAVE = {n: ", ".join(f"'{q}'" for q, fields in kinds.KINDS.items() if n in fields) for n in kinds.FIELDS}


@query(
    "journal_payloads",
    _EVENT + "SELECT event_id, execution_id, kind, " + ", ".join(f'CASE WHEN kind IN ({_HAVE[n]}) THEN {v} END AS "{n}"' for n, v in _VALUES.items() if v)
    + ", CASE WHEN kind = 'step_failed' THEN CASE WHEN k % 2 = 0 THEN 'timeout' ELSE 'crash' END END AS error_kind, CASE WHEN kind = 'step_failed' THEN 'no. ' || k END AS error_message FROM j",
    views=False,
)
def journal_payloads(s, d):
    """Every field of every kind, read back from stored payloads."""
    stored = written(_kinds(s, d).drop("ts", "k"), "payloads")
    return kinds.wide(stored, "event_id", "execution_id").select("*", F.col("error.kind").alias("error_kind"), F.col("error.message").alias("error_message")).drop("error")


@query("journal_step_durations", _EVENT + "SELECT 'step-' || k AS step_id, CAST(1 + k % 5 AS INTEGER) AS attempt, count(*) AS events, max(value) AS longest, sum(CAST(round(value * 100) AS BIGINT)) AS hundredths FROM j WHERE kind = 'step_completed' GROUP BY 1, 2", views=False)
def journal_step_durations(s, d):
    """One kind's fields, grouped; the scan reads those only."""
    stored = written(_kinds(s, d), "payloads")
    done = kinds.of_kind(stored, "step_completed")
    return done.groupBy("step_id", "attempt").agg(F.count(F.lit(1)).alias("events"), F.max("duration").alias("longest"), F.sum(F.round(F.col("duration") * 100).cast("long")).alias("hundredths"))


@query(
    "journal_payload_problems",
    _EVENT + "SELECT event_id, CASE WHEN k % 10 = 0 THEN ['unknown kind'] WHEN k % 10 = 1 AND kind = 'step_completed' THEN ['missing attempt', 'unexpected extra'] WHEN k % 10 = 1 AND kind = 'execution_stopped' THEN ['missing reason', 'missing graceful', 'unexpected attempt', 'unexpected extra', 'unexpected step_id'] END AS problems FROM j WHERE k % 10 = 0 OR (k % 10 = 1 AND kind IN ('step_completed', 'execution_stopped'))",
    views=False,
)
def journal_payload_problems(s, d):
    """Events of a kind that does not exist, with a field of another type, with another kind's fields."""
    j = _kinds(s, d)
    tenth = F.col("k") % 10
    bad = F.parse_json(F.to_json(F.struct(F.concat(F.lit("step-"), F.col("k").cast("string")).alias("step_id"), F.lit("first").alias("attempt"), F.lit(1.5).alias("duration"), F.lit(1).alias("extra"))))
    stop = F.parse_json(F.lit('{"step_id": "s", "attempt": 1, "extra": null}'))
    j = j.withColumn("payload", F.when((tenth == 1) & (F.col("kind") == "step_completed"), bad).when((tenth == 1) & (F.col("kind") == "execution_stopped"), stop).otherwise(F.col("payload")))
    j = j.withColumn("kind", F.when(tenth == 0, "step_lost").otherwise(F.col("kind")))
    # a filter goes down through what is merely selected, and would make the payload anew wherever a check reads it
    found = j.select("event_id", F.explode_outer(F.array(kinds.problems(F.col("kind")))).alias("problems"))
    return found.where(F.size("problems") > 0)


# ---- tables of commits ---------------------------------------------------------------------------------------------


def _prices(s, d):
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("body"))


@query(
    "commit_concurrent_writers",
    "SELECT o_orderkey AS trial_id, o_totalprice + CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS price, o_orderpriority AS body FROM orders WHERE o_orderkey % 7 <> 0",
    views=False,
)
def commit_concurrent_writers(s, d):
    """Two writers at once, a plan that is saved again, a correction, a delete: what is left."""
    rows, path, failed = _prices(s, d), new_folder(s, "commits"), []

    def write(part):
        try:
            Table(s, path).upsert(rows.where(F.col("trial_id") % 2 == part))
        except Exception as e:  # noqa: BLE001 - raised below, in the caller's thread
            failed.append(e)

    writers = [threading.Thread(target=write, args=(part,)) for part in (0, 1)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    if failed:
        raise failed[0]
    table = Table(s, path)
    table.save_once(rows.where("trial_id % 5 = 0"), ["trial_id"], "body")
    table.upsert(rows.where("trial_id % 4 = 1").withColumn("price", F.col("price") + 1))
    table.delete(rows.where("trial_id % 7 = 0").select("trial_id"))
    return table.read(["trial_id"])


@query(
    "commit_time_travel",
    "SELECT 1::BIGINT AS version, count(*) AS trials, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, count(*), max(o_orderkey) FROM orders UNION ALL SELECT 3, count(*), max(o_orderkey) FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 4, count(*), max(o_orderkey) FROM orders WHERE o_orderkey % 7 <> 0",
    views=False,
)
def commit_time_travel(s, d):
    """How many rows each version has, the compacted one included."""
    rows, table = _prices(s, d), Table(s, new_folder(s, "commits"))
    table.create(rows.where("trial_id % 2 = 0"), ["trial_id"])
    table.create(rows.where("trial_id % 2 = 1"), ["trial_id"])
    table.delete(rows.where("trial_id % 7 = 0").select("trial_id"))
    table.compact(["trial_id"])
    found = [table.read(["trial_id"], v).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("trials"), F.max("trial_id").alias("last")) for v in table.versions()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
