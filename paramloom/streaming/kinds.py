"""The journal's event kinds and their payloads as VARIANT.

A payload is one semi-structured column for all kinds. Written as Parquet it is shredded (fields that files often hold
become columns of their own), and a field that a query asks for is read by itself: the scan's schema has that field only.
Works on batches and streams alike: one row in, one row out, nothing but built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each kind's payload fields with the types they have in a journal. Durations are seconds.
KINDS = {
    "execution_started": {"plan_fingerprint": "string"},
    "execution_resumed": {"checkpoint_id": "string"},
    "execution_paused": {"reason": "string"},
    "execution_stopped": {"reason": "string", "graceful": "boolean"},
    "execution_completed": {"success": "boolean", "duration": "double"},
    "step_started": {"step_id": "string", "attempt": "int"},
    "step_completed": {"step_id": "string", "attempt": "int", "duration": "double"},
    "step_failed": {"step_id": "string", "attempt": "int", "error": "struct<kind:string,message:string>"},
    "step_skipped": {"step_id": "string", "reason": "string"},
    "instance_state_change": {"instance_id": "string", "from": "string", "to": "string"},
    "barrier_reached": {"barrier_id": "string"},
    "barrier_timed_out": {"barrier_id": "string", "waited": "double"},
    "checkpoint_created": {"checkpoint_id": "string", "completed_step_count": "int"},
    "trial_started": {"trial_id": "string", "trial_index": "int"},
    "trial_completed": {"trial_id": "string", "status": "string"},
}
#: every field of any kind, with its type
FIELDS = reduce(lambda a, b: a | b, KINDS.values())


def payload(fields: dict[str, Column]) -> Column:
    """A payload from its fields; fields that are null are not in it."""
    return F.parse_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))


def field(name: str, payload: str = "payload") -> Column:
    """A payload's field by its type; null where the payload has no such field or it has another type."""
    kind = FIELDS[name]
    if kind.startswith("struct"):
        inner = [p.split(":") for p in kind[7:-1].split(",")]
        parts = [F.try_variant_get(payload, f"$.{name}.{n}", t) for n, t in inner]
        whole = F.struct(*[p.alias(n) for p, (n, _) in zip(parts, inner)])
        return F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), whole)
    return F.try_variant_get(payload, f"$.{name}", kind)


def of_kind(journal: DataFrame, kind: str, *keep: str) -> DataFrame:
    """The events of one kind: the columns to keep and the kind's fields, typed."""
    if kind not in KINDS:
        raise ValueError(f"no event kind {kind!r}")
    return journal.where(F.col("kind") == kind).select(*keep, *[field(n).alias(n) for n in KINDS[kind]])


def wide(journal: DataFrame, *keep: str) -> DataFrame:
    """All events with every field of any kind as a column; a field that the event's kind does not have is null."""

    def own(name: str) -> Column:
        having = [k for k, fields in KINDS.items() if name in fields]
        return F.when(F.col("kind").isin(having), field(name)).alias(name)

    return journal.select(*keep, "kind", *map(own, FIELDS))


def problems(kind: Column, payload: str = "payload") -> Column:
    """What is wrong with an event, all of it: `unknown kind`, or `missing f` / `unexpected f` by field.

    A field that is there with another type than its own is missing."""
    names = F.json_object_keys(F.coalesce(F.to_json(F.col(payload)), F.lit("{}")))
    named = {k: F.array(*map(F.lit, fields)) for k, fields in KINDS.items()}
    checks = F.lit(None).cast("array<string>")
    for k, fields in KINDS.items():
        missing = F.array_compact(F.array(*[F.when(field(n, payload).isNull(), F.lit(f"missing {n}")) for n in fields]))
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(names, F.array().cast("array<string>")), named[k])), lambda n: F.concat(F.lit("unexpected "), n))
        checks = F.when(kind == k, F.concat(missing, extra)).otherwise(checks)
    return F.when(F.coalesce(kind.isin(list(KINDS)), F.lit(False)), checks).otherwise(F.array(F.lit("unknown kind")))
