"""Orders in which steps of a queue come up, sums of what they allocate, delays before they are tried again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick_order(steps: DataFrame, policy: str) -> DataFrame:
    """steps (step, trial, priority, cpu, memory) with `turn`, one number after another per queue."""
    if policy == "fair":
        own = Window.partitionBy("queue", "trial").orderBy("step")
        steps = steps.withColumn("_round", F.row_number().over(own))
        order = ["_round", "trial", "step"]
    else:
        order = {"fifo": ["step"], "priority": [F.desc("priority"), "step"], "resource_aware": [F.desc("cpu"), F.desc("memory"), "step"]}[policy]
    return steps.withColumn("turn", F.row_number().over(Window.partitionBy("queue").orderBy(*order))).drop("_round")


def admit(steps: DataFrame, cpu: float, memory: float) -> DataFrame:
    """In order of `turn`, admit each step that still fits (steps that don't are passed over): sequential by nature,
    so each queue is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, left_cpu, left_memory, taken = rows.sort_values("turn"), cpu, memory, []
        for c, m in zip(rows["cpu"], rows["memory"]):
            ok = c <= left_cpu and m <= left_memory
            left_cpu, left_memory = left_cpu - c * ok, left_memory - m * ok
            taken.append(ok)
        return rows.assign(admitted=taken)[["queue", "step", "turn", "admitted"]]

    return steps.groupBy("queue").applyInPandas(run, steps.select("queue", "step", "turn").withColumn("admitted", F.lit(True)).schema)


def usage(allocations: DataFrame, *keys: str) -> DataFrame:
    return allocations.groupBy(*keys).agg(F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory"))


def backoff(attempt, kind: str, base: float, factor: float = 2.0):
    """Seconds before the next attempt: none, fixed, linear or exponential."""
    return {"none": F.lit(0.0), "fixed": F.lit(base), "linear": F.lit(base) * attempt, "exponential": F.lit(base) * F.pow(F.lit(factor), attempt)}[kind]
