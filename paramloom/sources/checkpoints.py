"""Checkpoints and suspensions as tables of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import latest_checkpoint, prune_checkpoints
from .commits import Table


class Checkpoints:
    """Records (checkpoint_id, execution_id, created_at, body): saving an id again replaces its record."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = Table(spark, path)

    def save(self, rows: DataFrame) -> int:
        return self.table.upsert(rows)

    def all(self) -> DataFrame:
        return self.table.read(["checkpoint_id"])

    def get(self, checkpoint_id) -> DataFrame:
        """One record; LookupError if there is none."""
        found = self.all().where(F.col("checkpoint_id") == F.lit(checkpoint_id))
        if not found.limit(1).count():
            raise LookupError(f"no checkpoint {checkpoint_id!r}")
        return found

    def delete(self, ids: DataFrame) -> int:
        """Take records away by their ids; ids without a record change nothing."""
        return self.table.delete(ids.select("checkpoint_id"))

    def latest(self) -> DataFrame:
        return latest_checkpoint(self.all())

    def prune(self, keep: int) -> int:
        """Keep the newest of each execution."""
        old = self.all()
        return self.delete(old.join(prune_checkpoints(old, keep).select("checkpoint_id"), "checkpoint_id", "left_anti"))


class Suspensions:
    """Records (execution_id, suspended_at, body): the last suspension of an execution counts; resuming takes it away."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = Table(spark, path)

    def suspend(self, rows: DataFrame) -> int:
        return self.table.upsert(rows)

    def resume(self, executions: DataFrame) -> int:
        return self.table.delete(executions.select("execution_id"))

    def all(self) -> DataFrame:
        return self.table.read(["execution_id"])
