"""Assignments, metrics, resources and instances of many trials at once: lookups, counts, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

# ---- assignments (trial_id, element, parameter, value, ...) and metrics (trial_id, element, parameter, value_num) --------


def get(rows: DataFrame, element: str, parameter: str) -> DataFrame:
    """One coordinate's rows."""
    return rows.where((F.col("element") == element) & (F.col("parameter") == parameter))


def of_element(rows: DataFrame, element: str) -> DataFrame:
    return rows.where(F.col("element") == element)


def in_order(rows: DataFrame) -> DataFrame:
    """All rows by trial, element and parameter (names in the order of their bytes)."""
    return rows.orderBy("trial_id", "element", "parameter")


def sizes(trials: DataFrame, rows: DataFrame) -> DataFrame:
    """(trial_id, entries, elements, empty) of every trial, those without rows included."""
    counts = rows.groupBy("trial_id").agg(F.count_distinct("element", "parameter").alias("entries"), F.count_distinct("element").alias("elements"))
    out = trials.select("trial_id").distinct().join(counts, "trial_id", "left")
    return out.select("trial_id", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("elements", F.lit(0)).alias("elements"), F.col("entries").isNull().alias("empty"))


def assignment_problems(rows: DataFrame) -> DataFrame:
    """(trial_id, element, parameter, problem): elements without a name, values addressed to another parameter
    (value_parameter), coordinates that are assigned twice."""
    bad = F.when(F.coalesce("element", F.lit("")) == "", "no element").when(~F.col("value_parameter").eqNullSafe(F.col("parameter")), "addressed to another parameter")
    single = rows.withColumn("problem", bad).where("problem is not null").select("trial_id", "element", "parameter", "problem")
    twice = rows.groupBy("trial_id", "element", "parameter").count().where("count > 1")
    return single.unionByName(twice.select("trial_id", "element", "parameter", F.lit("assigned twice").alias("problem")))


# ---- resources -----------------------------------------------------------------------------------------------------

AMOUNTS = ("cpu", "memory", "storage", "network")


def resource_usage(allocations: DataFrame, *keys: str) -> DataFrame:
    """keys, active, AMOUNTS, custom: sums of live allocations, custom amounts (a map) key by key. Nulls count as 0."""
    sums = allocations.groupBy(*keys).agg(F.count(F.lit(1)).alias("active"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in AMOUNTS])
    parts = allocations.select(*keys, F.explode("custom").alias("_name", "_amount")).groupBy(*keys, "_name").agg(F.sum("_amount").alias("_amount"))
    custom = parts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_amount")))).alias("custom"))  # as many entries as there are kinds of resources
    same = [sums[k].eqNullSafe(custom[k]) for k in keys]
    out = sums.join(custom, same, "left") if keys else sums.crossJoin(custom)  # without keys: single rows
    return out.select(*[sums[k] for k in keys], "active", *AMOUNTS, F.coalesce("custom", F.create_map().cast(custom.schema["custom"].dataType)).alias("custom"))


# ---- instances (instance, element, grp) and their edges (src, dst, kind) --------------------------------------------


def edges_from(edges: DataFrame, instances: DataFrame) -> DataFrame:
    return edges.join(instances.select(F.col("instance").alias("src")), "src", "left_semi")


def edges_to(edges: DataFrame, instances: DataFrame) -> DataFrame:
    return edges.join(instances.select(F.col("instance").alias("dst")), "dst", "left_semi")


def instance_summary(instances: DataFrame, edges: DataFrame) -> DataFrame:
    """(instance, element, outgoing, incoming, depth) of every instance; depth orders them topologically."""
    outgoing = edges.groupBy(F.col("src").alias("instance")).agg(F.count(F.lit(1)).alias("outgoing"))
    incoming = edges.groupBy(F.col("dst").alias("instance")).agg(F.count(F.lit(1)).alias("incoming"))
    deep = graph.depths(instances.select(F.col("instance").alias("node")), edges.select("src", "dst")).withColumnRenamed("node", "instance")
    out = instances.select("instance", "element").join(deep, "instance").join(outgoing, "instance", "left").join(incoming, "instance", "left")
    return out.select("instance", "element", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"), "depth")


def instance_problems(instances: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, node): instances that are repeated, edges to instances that don't exist, edges to themselves."""
    found = graph.problems(instances.select(F.col("instance").alias("node")), edges.select("src", "dst"))
    return found.unionByName(edges.where("src = dst").select(F.lit("own edge").alias("problem"), F.col("src").alias("node")).distinct())
