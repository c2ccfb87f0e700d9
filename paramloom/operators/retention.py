"""Artifact retention: age, newest per context, size cap per context; and latest-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_newest(rows: DataFrame, context: list[str], created: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*context).orderBy(F.desc(created), F.desc(key))
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def keep_size(rows: DataFrame, context: list[str], created: str, key: str, size: str, cap: int) -> DataFrame:
    """Evict oldest first while a context holds more than cap: what stays of later rows, this one included, decides."""
    order = Window.partitionBy(*context).orderBy(F.desc(created), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_held", F.sum(size).over(order)).where(F.col("_held") <= cap).drop("_held")


def keep_young(rows: DataFrame, created: str, oldest) -> DataFrame:
    return rows.where(F.col(created) >= F.lit(oldest))


def retain(rows: DataFrame, context: list[str], created: str, key: str, size: str, oldest=None, newest: int | None = None, cap: int | None = None) -> DataFrame:
    """Age, then newest, then size, each on the survivors of the one before."""
    if oldest is not None:
        rows = keep_young(rows, created, oldest)
    if newest is not None:
        rows = keep_newest(rows, context, created, key, newest)
    return rows if cap is None else keep_size(rows, context, created, key, size, cap)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last version of each key."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first version of each key (idempotent appends)."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
