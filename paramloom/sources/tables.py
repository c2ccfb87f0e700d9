"""Catalog tables of a store: created if absent, bucketed by the key they are joined on, so that joins move no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: each table's columns and the key of its buckets
TABLES = {
    "trial_results": ("trial_id BIGINT, execution_id BIGINT, status STRING, attempt INT, started_at TIMESTAMP_NTZ, code STRING", "trial_id"),
    "trial_metrics": ("trial_id BIGINT, element STRING, parameter STRING, value_num DOUBLE", "trial_id"),
    "assignments": ("trial_id BIGINT, element STRING, parameter STRING, value STRING", "trial_id"),
    "journal_events": ("execution_id BIGINT, sequence BIGINT, ts TIMESTAMP_NTZ, kind STRING, step_id STRING, payload VARIANT", "execution_id"),
    "checkpoints": ("execution_id BIGINT, checkpoint_id BIGINT, created_at TIMESTAMP_NTZ, body STRING", "execution_id"),
    "executions": ("execution_id BIGINT, plan_fingerprint STRING, status STRING, started_at TIMESTAMP_NTZ, labels MAP<STRING, STRING>, tags MAP<STRING, STRING>", "execution_id"),
    "execution_plans": ("fingerprint STRING, name STRING, compiled_at TIMESTAMP_NTZ, body STRING, labels MAP<STRING, STRING>, tags MAP<STRING, STRING>", "fingerprint"),
    "plan_metadata": ("scope STRING, id STRING, body STRING, labels MAP<STRING, STRING>, tags MAP<STRING, STRING>", "id"),
    "artifacts": ("artifact_id STRING, execution_id BIGINT, trial_id BIGINT, element STRING, name STRING, content_type STRING, size_bytes BIGINT, uri STRING, content BINARY, created_at TIMESTAMP_NTZ", "execution_id"),
    "suspensions": ("execution_id BIGINT, suspended_at TIMESTAMP_NTZ, body STRING", "execution_id"),
}


def migrate(spark: SparkSession, database: str, location: str | None = None, buckets: int = 64) -> list[str]:
    """Create the database and whichever tables are not there; those that are stay as they are. Returns the new ones."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    have = {t.name for t in spark.catalog.listTables(database)}
    new = [t for t in TABLES if t not in have]
    for name in new:
        columns, key = TABLES[name]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")
    return new


def insert(rows: DataFrame, database: str, name: str) -> None:
    """Add rows; each task writes the files of its buckets, so rows are dealt by the key first (a file a bucket, not a
    file a task and bucket)."""
    spark = rows.sparkSession
    table = spark.table(f"{database}.{name}")
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {database}.{name}").where("col_name = 'Num Buckets'").first()["data_type"])
    rows.select(*table.columns).repartition(buckets, TABLES[name][1]).write.insertInto(f"{database}.{name}")


def join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two tables with the same buckets: merged bucket by bucket, whatever their sizes."""
    return left.join(right.hint("merge"), key)
