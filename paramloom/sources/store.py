"""A store of result, metric, journal and artifact tables: logs of commits over Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import ConflictError, Table

__all__ = ["ConflictError", "Store", "explode_metrics", "payload", "save_artifacts"]


def explode_metrics(results: DataFrame) -> DataFrame:
    """results (trial_id, metrics map of "element.parameter" -> double) -> (trial_id, element, parameter, value_num)."""
    rows = results.select("trial_id", F.explode("metrics").alias("name", "value_num"))
    return rows.select("trial_id", F.substring_index("name", ".", 1).alias("element"), F.expr("substr(name, instr(name, '.') + 1)").alias("parameter"), "value_num")


class Store:
    """Tables by name, each a log of commits (see commits.py). root may be on any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}")

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.table(table).upsert(rows)

    def delete(self, table: str, rows: DataFrame) -> None:
        self.table(table).delete(rows)

    def read(self, table: str, keys: list[str]) -> DataFrame:
        return self.table(table).read(keys)

    def get(self, table: str, keys: list[str], **key) -> DataFrame:
        out = self.read(table, keys)
        for k, v in key.items():
            out = out.where(F.col(k) == F.lit(v))
        return out

    def save_once(self, table: str, keys: list[str], rows: DataFrame, body: str) -> None:
        """Saving the same body again does nothing; another body is a conflict."""
        self.table(table).save_once(rows, keys, body)


def save_artifacts(old: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """create_new refuses existing keys, replace overwrites them, version adds a record beside."""
    keys = ["execution_id", "trial_id", "element", "name"]
    if mode == "create_new":
        if new.join(old, keys, "left_semi").limit(1).count():
            raise ConflictError("artifact")
    elif mode == "replace":
        old = old.join(new, keys, "left_anti")
    return old.unionByName(new)


def payload(artifacts: DataFrame, fetched: str = "fetched") -> DataFrame:
    """The inline content, else what was fetched from the uri, else empty bytes."""
    return artifacts.withColumn("payload", F.coalesce("content", fetched, F.lit(b"")))
