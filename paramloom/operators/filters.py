"""Result filters: an AST over trial results that compiles to one predicate, plus semi-joins for metrics and assignments.

Two-valued throughout: a missing metric, label or assignment makes a leaf false, and its negation true.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def compare(left: Column, cmp: str, value) -> Column:
    """Numbers compare with a tolerance of one epsilon for equality; other values only by eq and ne."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if cmp in ("eq", "ne"):
            same = F.abs(left - F.lit(float(value))) < F.lit(EPSILON)
            return same if cmp == "eq" else ~same
        return _COMPARE[cmp](left, F.lit(float(value)))
    return _COMPARE[cmp](left, F.lit(value)) if cmp in ("eq", "ne") else F.lit(False)


@dataclass(frozen=True)
class Filter:
    """op and its arguments. Leaves: any, trial_id, execution_id, plan_fingerprint, status, status_in, started_after,
    started_before, attempt, metric, assignment, code, code_prefix, label, tag; combinators: and, or, not."""

    op: str
    args: tuple = ()

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", (self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", (self, other))

    def __invert__(self) -> Filter:
        return Filter("not", (self,))


def where(op: str, *args) -> Filter:
    return Filter(op, args)


def _side_tables(f: Filter) -> list[Filter]:
    if f.op in ("and", "or", "not"):
        return [x for a in f.args for x in _side_tables(a)]
    return [f] if f.op in ("metric", "assignment") else []


def predicate(f: Filter, flags: dict[Filter, Column]) -> Column:
    a = f.args
    if f.op == "and":
        return reduce(operator.and_, (predicate(x, flags) for x in a), F.lit(True))
    if f.op == "or":
        return reduce(operator.or_, (predicate(x, flags) for x in a), F.lit(False))
    if f.op == "not":
        return ~predicate(a[0], flags)
    made = {
        "any": lambda: F.lit(True),
        "trial_id": lambda: F.col("trial_id") == F.lit(a[0]),
        "execution_id": lambda: F.col("execution_id") == F.lit(a[0]),
        "plan_fingerprint": lambda: F.col("plan_fingerprint") == F.lit(a[0]),
        "status": lambda: F.col("status") == F.lit(a[0]),
        "status_in": lambda: F.col("status").isin(list(a[0])) if a[0] else F.lit(False),
        "started_after": lambda: F.col("started_at") > F.lit(a[0]).cast("timestamp"),
        "started_before": lambda: F.col("started_at") < F.lit(a[0]).cast("timestamp"),
        "attempt": lambda: _COMPARE[a[0]](F.col("attempt"), F.lit(a[1])),
        "code": lambda: F.col("code") == F.lit(a[0]),
        "code_prefix": lambda: F.startswith(F.col("code"), F.lit(a[0])),
        "label": lambda: F.col("labels")[a[0]] == F.lit(a[1]),
        "tag": lambda: F.col("tags")[a[0]] == F.lit(a[1]),
    }
    leaf = flags[f] if f in flags else made[f.op]()
    return F.coalesce(leaf, F.lit(False))


def _matches(f: Filter, metrics: DataFrame | None, assignments: DataFrame | None) -> DataFrame:
    """Distinct trial_ids for which a metric or assignment leaf holds."""
    side = metrics if f.op == "metric" else assignments
    element, parameter = f.args[:2]
    rows = side.where((F.col("element") == element) & (F.col("parameter") == parameter))
    if f.op == "metric":
        number = isinstance(f.args[3], (int, float)) and not isinstance(f.args[3], bool)
        column = "value_num" if number else "value_bool" if isinstance(f.args[3], bool) else "value_text"
        rows = rows.where(F.coalesce(compare(F.col(column), f.args[2], f.args[3]), F.lit(False)))
    else:
        rows = rows.where(F.col("value") == F.lit(f.args[2]))
    return rows.select("trial_id").distinct()


def apply_filter(results: DataFrame, f: Filter, metrics: DataFrame | None = None, assignments: DataFrame | None = None) -> DataFrame:
    """Rows of results that satisfy f. Conjoined metric leaves become semi- and anti-joins; only leaves under an
    Or or a nested Not need a flag column from a left join."""
    spine = list(f.args) if f.op == "and" else [f]
    rest = []
    for x in spine:
        leaf, negative = (x.args[0], True) if x.op == "not" else (x, False)
        if leaf.op in ("metric", "assignment"):
            results = results.join(_matches(leaf, metrics, assignments), "trial_id", "left_anti" if negative else "left_semi")
        else:
            rest.append(x)
    f = Filter("and", tuple(rest))
    flags: dict[Filter, Column] = {}
    columns = results.columns
    for i, leaf in enumerate(dict.fromkeys(_side_tables(f))):
        results = results.join(_matches(leaf, metrics, assignments).withColumn(f"_flag{i}", F.lit(True)), "trial_id", "left")
        flags[leaf] = F.col(f"_flag{i}")
    return results.where(predicate(f, flags)).select(*columns)
