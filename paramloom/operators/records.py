"""Stored records as tables: plan, execution and artifact listings, validation, metadata, checkpoints, cleanup.

Every listing is a conjunction of the conditions that are given; absent labels and tags make theirs false. Time bounds
are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.constraints import violations
from .retention import keep_newest

TERMINAL = ("completed", "failed", "skipped", "cancelled")
SCOPES = ("test_plan", "execution_plan", "execution", "trial", "artifact")


def _all(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, conditions, F.lit(True)), F.lit(False))


def _entries(column: str, wanted: dict[str, str]) -> list[Column]:
    return [F.col(column)[k] == F.lit(v) for k, v in wanted.items()]


def _between(column: str, after: datetime | None, before: datetime | None) -> list[Column]:
    found = [] if after is None else [F.col(column) > F.lit(after)]
    return found + ([] if before is None else [F.col(column) < F.lit(before)])


@dataclass(frozen=True)
class PlanFilter:
    """Plans (fingerprint, name, compiled_at, labels, tags) by source, part of the name, time, labels and tags."""

    fingerprint: str | None = None
    name_contains: str | None = None
    compiled_after: datetime | None = None
    compiled_before: datetime | None = None
    labels: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)

    def apply(self, plans: DataFrame) -> DataFrame:
        found = [] if self.fingerprint is None else [F.col("fingerprint") == self.fingerprint]
        found += [] if self.name_contains is None else [F.contains(F.col("name"), F.lit(self.name_contains))]
        found += _between("compiled_at", self.compiled_after, self.compiled_before)
        return plans.where(_all(found + _entries("labels", self.labels) + _entries("tags", self.tags)))


@dataclass(frozen=True)
class ExecutionFilter:
    """Executions (plan_fingerprint, status, started_at, labels, tags) by plan, status, time, labels and tags."""

    plan_fingerprint: str | None = None
    status: str | None = None
    started_after: datetime | None = None
    started_before: datetime | None = None
    labels: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)

    def apply(self, executions: DataFrame) -> DataFrame:
        found = [F.col(c) == v for c, v in (("plan_fingerprint", self.plan_fingerprint), ("status", self.status)) if v is not None]
        found += _between("started_at", self.started_after, self.started_before)
        return executions.where(_all(found + _entries("labels", self.labels) + _entries("tags", self.tags)))


def artifacts_of(artifacts: DataFrame, execution_id=None, trial_id=None, element: str | None = None) -> DataFrame:
    """Artifacts of a context; parts that are not given match all."""
    given = {"execution_id": execution_id, "trial_id": trial_id, "element": element}
    return artifacts.where(_all([F.col(c) == F.lit(v) for c, v in given.items() if v is not None]))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def is_success(status: Column) -> Column:
    return F.coalesce(status == "completed", F.lit(False))


def is_failure(status: Column) -> Column:
    return F.coalesce(status == "failed", F.lit(False))


def duration_seconds(started: Column, completed: Column) -> Column:
    return (F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / F.lit(1e6)


def result_violations() -> Column:
    """What is wrong with a result row: attempt, error exactly if failed, reason exactly if skipped, end not before start."""
    failed, skipped = F.col("status") == "failed", F.col("status") == "skipped"
    has_error, has_reason = F.col("error").isNotNull(), F.col("skip_reason").isNotNull()
    return violations(
        {
            "attempt is zero": F.col("attempt") >= 1,
            "failure without error": ~failed | has_error,
            "skip without reason": ~skipped | has_reason,
            "error without failure": failed | ~has_error,
            "reason without skip": skipped | ~has_reason,
            "ends before it starts": F.col("completed_at") >= F.col("started_at"),
        }
    )


def element_violations(elements: DataFrame, types: DataFrame) -> DataFrame:
    """(element, violations): elements (element, labels, tags maps; ports: the names of all plugs and sockets, parameters,
    result_parameters, config_keys arrays; max_concurrency, max_group_concurrency) against types (type, required,
    forbidden arrays of label keys). A name is one port only: neither two plugs, two sockets nor one of each share it."""
    e = elements.withColumn("_type", F.col("labels")["type"]).join(types.withColumnRenamed("type", "_known"), F.col("_type") == F.col("_known"), "left")
    keys = F.map_keys("labels")
    tiers = F.concat(keys, F.map_keys("tags"), F.array_distinct("ports"))
    none = F.array().cast("array<string>")
    checks = {
        "no type label": F.col("_type").isNotNull(),
        "unknown type": F.col("_type").isNull() | F.col("_known").isNotNull(),
        "required label missing": F.size(F.array_except(F.coalesce("required", none), keys)) == 0,
        "forbidden label": ~F.arrays_overlap(F.coalesce("forbidden", none), keys),
        "repeated parameter": F.size(F.array_distinct("parameters")) == F.size("parameters"),
        "repeated result parameter": F.coalesce(F.size(F.array_distinct("result_parameters")) == F.size("result_parameters"), F.lit(True)),
        "configuration of no parameter": F.size(F.array_except("config_keys", "parameters")) == 0,
        "repeated port": F.size(F.array_distinct("ports")) == F.size("ports"),
        "name in two tiers": F.size(F.array_distinct(tiers)) == F.size(tiers),
        "parameter named like an attribute": ~F.arrays_overlap("parameters", tiers),
        "concurrency below one": F.coalesce(F.col("max_concurrency") >= 1, F.lit(True)),
        "group concurrency above all": F.coalesce(F.col("max_group_concurrency") <= F.col("max_concurrency"), F.lit(True)),
    }
    return e.select("element", violations(checks).alias("violations"))


# ---- metadata: one record a (scope, id): body (JSON text), labels, tags ---------------------------------------------

EMPTY_BODY = "{}"


def _one_each(changes: DataFrame, value: str) -> DataFrame:
    """(scope, id, _new): of changes that repeat a key the one with the largest hash, so that it is always the same."""
    content = F.array_sort(F.map_entries(value)) if isinstance(changes.schema[value].dataType, MapType) else F.col(value)
    return changes.groupBy("scope", "id").agg(F.max_by(value, F.xxhash64(content)).alias("_new"), F.lit(True).alias("_given"))


def _put(records: DataFrame, changes: DataFrame, value: str, column: str) -> DataFrame:
    """records with column set where there is a change, and a new record for each change without one."""
    both = records.join(_one_each(changes, value), ["scope", "id"], "full")
    none = F.create_map().cast("map<string,string>")
    empty = {"body": F.lit(EMPTY_BODY), "labels": none, "tags": none}
    old = {c: F.coalesce(c, empty[c]) for c in empty}
    return both.select("scope", "id", *[(F.when(F.col("_given"), F.col("_new")).otherwise(old[c]) if c == column else old[c]).alias(c) for c in empty])


def put_metadata(records: DataFrame, new: DataFrame) -> DataFrame:
    """records (scope, id, body, labels, tags) with the bodies of new (scope, id, body); labels and tags stay as they
    are, a record that is new has none."""
    return _put(records, new, "body", "body")


def set_map(records: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    """records with `labels` or `tags` replaced by changes (scope, id, entries); a record that does not exist yet is made,
    with an empty body and nothing else."""
    if column not in ("labels", "tags"):
        raise ValueError(f"no map {column!r}")
    return _put(records, changes, "entries", column)


def list_scope(records: DataFrame, scope: str, cursor=None, size: int = 100) -> DataFrame:
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope!r}")
    rows = records.where(F.col("scope") == scope)
    rows = rows if cursor is None else rows.where(F.col("id") > F.lit(cursor))
    return rows.orderBy("id").limit(min(1000, max(1, size)))


def page_with_token(rows: DataFrame, key: str, cursor=None, size: int = 100) -> DataFrame:
    """A keyset page whose rows carry next_token: the last key if further rows follow, else null.

    One row more than the page is read; the page itself is at most 1,000 rows."""
    size = min(1000, max(1, size))
    rows = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    seen = rows.orderBy(key).limit(size + 1)
    ends = seen.agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(key)).alias("_keys"))
    token = F.when(F.col("_n") > size, F.get("_keys", F.lit(size - 1)))
    return seen.orderBy(key).limit(size).crossJoin(ends.select(token.alias("next_token")))  # a single row


# ---- checkpoints and cleanup ---------------------------------------------------------------------------------------


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Per execution the newest by (created_at, checkpoint_id), without sorting a group."""
    newest = checkpoints.groupBy("execution_id").agg(F.max(F.struct("created_at", "checkpoint_id")).alias("_c"))
    return newest.select("execution_id", F.col("_c.created_at").alias("created_at"), F.col("_c.checkpoint_id").alias("checkpoint_id"))


def prune_checkpoints(checkpoints: DataFrame, keep: int) -> DataFrame:
    return keep_newest(checkpoints, ["execution_id"], "created_at", "checkpoint_id", keep)


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """rows whose keys are not in gone: deletes by key."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def clean_up(tables: dict[str, DataFrame], executions: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given executions."""
    return {name: without(t, executions, "execution_id") for name, t in tables.items()}


def latest_execution(executions: DataFrame) -> DataFrame:
    """Per plan the execution that started last (of equals the largest id)."""
    top = executions.groupBy("plan_fingerprint").agg(F.max(F.struct("started_at", "execution_id")).alias("_e"))
    return top.select("plan_fingerprint", F.col("_e.execution_id").alias("execution_id"), F.col("_e.started_at").alias("started_at"))


def misaddressed(assignments: DataFrame) -> DataFrame:
    """Assignment rows without an element, or whose value is addressed to another parameter."""
    return assignments.where((F.coalesce("element", F.lit("")) == "") | ~F.col("value_parameter").eqNullSafe(F.col("parameter")))


def value_fingerprint(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, text), 256)


def intact(kind: Column, text: Column, fingerprint: Column) -> Column:
    """Whether a value still has the fingerprint that was stored with it."""
    return F.coalesce(value_fingerprint(kind, text) == fingerprint, F.lit(False))


def idempotency(step_kind: Column) -> Column:
    """Whether a step may be replayed."""
    return F.when(step_kind.isin("deploy", "await", "save_output"), "idempotent").otherwise("non_idempotent")
