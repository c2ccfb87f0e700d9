"""Aggregations over filtered trial results: an AST that compiles to grouped DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregation:
    """op: count, min, max, sum, avg, percentile; by: grouping dimensions ("status", ("assignment", e, p), ("digit", i, width))."""

    op: str
    metric: tuple[str, str] | None = None
    p: float = 0.5
    by: tuple = ()


def _dimension(results: DataFrame, d, i: int, assignments: DataFrame | None) -> tuple[DataFrame, str]:
    name = f"key{i}"
    if d == "status":
        return results.withColumn(name, F.col("status")), name
    if d[0] == "assignment":
        values = assignments.where((F.col("element") == d[1]) & (F.col("parameter") == d[2])).select("trial_id", F.col("value").alias(name))
        return results.join(values, "trial_id", "left"), name
    width = d[2] if len(d) > 2 else 1
    return results.withColumn(name, F.substring("code", 3 + d[1] * width, width)), name


def aggregate(results: DataFrame, a: Aggregation, metrics: DataFrame | None = None, assignments: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row per group (key0, key1, ...) with `value`; no rows give null, or an error if strict."""
    keys = []
    for i, d in enumerate(a.by):
        results, name = _dimension(results, d, i, assignments)
        keys.append(name)
    if a.op == "count":
        return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))
    numbers = metrics.where((F.col("element") == a.metric[0]) & (F.col("parameter") == a.metric[1]) & F.col("value_num").isNotNull()).select("trial_id", "value_num")
    rows = results.select("trial_id", *keys).join(numbers, "trial_id")
    if a.op == "percentile":
        out = percentile(rows, keys, "value_num", a.p)
    else:
        out = rows.groupBy(*keys).agg(getattr(F, a.op)("value_num").alias("value"))
    if strict:
        out = out.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(F.lit("no values to aggregate")).cast("double")).otherwise(F.col("value")))
    return out


BINS = 1024


def percentile(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The element at index floor(p * (n - 1)) of the sorted values; no interpolation.

    Values are counted first (map-side). Each group's range is then cut into BINS: the bin of the index follows from the
    bins' counts, and only that bin's distinct values are put in order. So a window sees a group's BINS counts, or the
    values of one bin, never all values of a group. NaN comes last, as in Spark's order, in a bin of its own.
    """
    p = min(1.0, max(0.0, p))
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    number = ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    ends = counts.groupBy(*keys).agg(F.min(F.when(number, F.col(value))).alias("_low"), F.max(F.when(number, F.col(value))).alias("_high"), F.sum("_n").alias("_all"))
    ends = ends.withColumn("_at", F.floor(F.lit(p) * (F.col("_all") - 1)))
    # halves first: the span of two doubles can be beyond the largest one
    share = (F.col(value) / 2 - F.col("_low") / 2) / F.nullif(F.col("_high") / 2 - F.col("_low") / 2, F.lit(0.0))
    inner = F.coalesce(F.floor(share * BINS), F.lit(0)).cast("int")
    bin_ = F.when(F.isnan(value), BINS + 1).when(F.col(value) == float("inf"), BINS).when(F.col(value) == float("-inf"), -1).otherwise(F.least(inner, F.lit(BINS - 1)))
    dealt = _joined(counts, ends, keys).withColumn("_bin", bin_)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("_n").over(part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = dealt.groupBy(*keys, "_bin", "_at").agg(F.sum("_n").alias("_n")).withColumn("_upto", upto)
    bins = bins.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select(*keys, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"))
    some = _joined(dealt, bins.withColumnRenamed("_bin", "_wanted"), keys).where(F.col("_bin") == F.col("_wanted"))
    upto = F.col("_before") + F.sum("_n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    hit = some.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
    return hit.select(*keys, F.col(value).alias("value"))


def _joined(rows: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their group's row (null keys are one group); without keys per_group is a single row."""
    if not keys:
        return rows.crossJoin(per_group)
    names = {k: f"_g{i}" for i, k in enumerate(keys)}
    other = per_group.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in names.items()]
    return rows.join(other, same).drop(*names.values())


def summary(results: DataFrame, *keys: str) -> DataFrame:
    """Counts by outcome per execution."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.groupBy(*keys).agg(is_("completed"), is_("failed"), is_("skipped"), F.count(F.lit(1)).alias("total"))


def page(rows: DataFrame, key: str, cursor=None, size: int = 100, descending: Column | None = None) -> DataFrame:
    """Keyset page: `size` rows (1 to 1000) after the cursor, by key."""
    size = min(1000, max(1, size))
    rows = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    return rows.orderBy(key).limit(size)


def page_desc(rows: DataFrame, when: str, key: str, cursor: tuple | None = None, size: int = 100) -> DataFrame:
    """Keyset page from the newest: by (when, key) descending, after the cursor pair."""
    if cursor is not None:
        w, k = F.lit(cursor[0]).cast(rows.schema[when].dataType), F.lit(cursor[1])
        rows = rows.where((F.col(when) < w) | ((F.col(when) == w) & (F.col(key) < k)))
    return rows.orderBy(F.desc(when), F.desc(key)).limit(min(1000, max(1, size)))
