"""Numbers and running sums of rows in a total order, without one task that sees all rows.

Rows are sorted into ranges and written (the ranges come from a sample, so they must not be found twice), each range is
counted or summed, and a row's number is what lies in earlier ranges plus its place in its own. One window runs within
ranges, another over one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _ranges(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[str]]:
    """rows with `_range` and the order's columns `_k0`.., written. Order must end in columns that tell all rows apart,
    else equal rows lie in one range."""
    names = [f"_k{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order)))
    dealt = keyed.repartitionByRange(*names)
    return written(dealt.withColumn("_range", F.spark_partition_id()), "ranges"), names


def numbered(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """rows with their number from 0 in ascending order (use negative or flipped keys for a descending one)."""
    return running(rows, {name: F.lit(1)}, *order, before=True)


def running(rows: DataFrame, sums: dict[str, Column], *order: Column, before: bool = False) -> DataFrame:
    """rows with running sums by name (longs), each row included; before: without the row itself."""
    table, names = _ranges(rows.withColumns({f"_s_{n}": c.cast("long") for n, c in sums.items()}), list(order))
    totals = table.groupBy("_range").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])  # one row a range
    own = Window.partitionBy("_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    out = table.join(offsets, "_range").withColumns({n: F.col(f"_o_{n}") + F.sum(f"_s_{n}").over(own) - (F.col(f"_s_{n}") if before else F.lit(0)) for n in sums})
    return out.select(*rows.columns, *sums)
