"""Parameter domains: membership, cardinality, boundaries, enumeration, sampling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constraints import Constraint, compile_constraint, leaf

UNBOUNDED = None


class NotEnumerable(ValueError):
    """A domain without a finite list of values."""


@dataclass(frozen=True)
class Domain:
    """kind with low/high (integer, double), values (integer set, selection items), pattern (string), most (selection)."""

    kind: str
    low: int | float | None = None
    high: int | float | None = None
    values: tuple = ()
    pattern: str | None = None
    most: int | None = None
    external: bool = False

    def cardinality(self) -> int | None:
        """Number of values, stopping at 2^64 - 1; None is unbounded. Selections count items."""
        if self.kind == "boolean":
            return 2
        if self.kind == "integer":
            return min(len(set(self.values)) if self.values else max(0, self.high - self.low + 1), (1 << 64) - 1)
        return len(set(self.values)) if self.kind == "selection" and not self.external else UNBOUNDED

    def boundaries(self) -> list:
        """First and last value without repeats."""
        if self.kind == "boolean":
            return [False, True]
        if self.kind == "string":
            return [""]
        if self.kind == "selection":
            return [] if self.external or not self.values else list(dict.fromkeys((self.values[0], self.values[-1])))
        ends = (min(self.values), max(self.values)) if self.values else (self.low, self.high)
        return list(dict.fromkeys(ends))

    def contains(self, value: Column) -> Column:
        """Two-valued membership (NaN and null are in no domain)."""
        if self.kind == "boolean":
            return value.isNotNull()
        if self.kind == "integer":
            return compile_constraint(leaf("integer", "in_set", *self.values) if self.values else leaf("integer", "range", self.low, self.high), value)
        if self.kind == "double":
            return compile_constraint(leaf("double", "range", self.low, self.high), value)
        if self.kind == "string":
            return compile_constraint(leaf("string", "regex", self.pattern) if self.pattern else Constraint("string", "always"), value)
        fits = F.size(value) <= (self.most if self.most is not None else 1 << 30)
        if not self.external:
            fits &= F.size(F.array_except(value, F.array(*[F.lit(v) for v in self.values]).cast("array<string>"))) == 0
        return F.coalesce(fits & value.isNotNull(), F.lit(False))

    def enumerate(self, spark: SparkSession) -> DataFrame:
        """One row per value, in order: (i, value). Ranges come from spark.range, not from the driver."""
        if self.kind == "integer" and not self.values:
            return spark.range(self.cardinality()).select(F.col("id").alias("i"), (F.col("id") + F.lit(self.low)).alias("value"))
        if self.kind == "boolean":
            return spark.range(2).select(F.col("id").alias("i"), (F.col("id") == 1).alias("value"))
        if self.kind in ("double", "string") or self.external:
            raise NotEnumerable(self.kind)
        items = sorted(set(self.values)) if self.kind == "integer" else list(dict.fromkeys(self.values))
        return spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in items])).alias("i", "value"))

    def sample(self, draw: Column, key: Column | None = None) -> Column:
        """A value for a uniform draw in [0, 1). A selection takes k items, k from 1 to its cap by the draw, in the order
        of their hashes with key (text; default: the draw). Strings cannot be sampled."""
        if self.kind == "boolean":
            return draw >= 0.5
        if self.kind == "integer":
            spot = F.floor(draw * F.lit(float(self.cardinality()))).cast("bigint")
            return F.get(F.array(*[F.lit(v) for v in sorted(set(self.values))]), spot.cast("int")) if self.values else F.lit(self.low) + spot
        if self.kind == "double":
            return F.lit(self.low) + draw * F.lit(self.high - self.low)
        if self.kind == "selection" and not self.external:
            items = list(dict.fromkeys(self.values))
            cap = max(1, min(len(items), self.most if self.most is not None else len(items)))
            seed = draw.cast("string") if key is None else key
            dealt = F.array_sort(F.array(*[F.struct(F.md5(F.concat(seed, F.lit(":" + v))).alias("h"), F.lit(v).alias("v")) for v in items]))
            return F.transform(F.slice(dealt, 1, (F.floor(draw * cap) + 1).cast("int")), lambda x: x["v"])
        raise NotEnumerable(self.kind)

    def boundary(self, draw: Column) -> Column:
        """One of the boundary values, for a uniform draw."""
        ends = self.boundaries()
        return F.get(F.array(*[F.lit(v) for v in ends]), F.floor(draw * len(ends)).cast("int"))

    def generate(self, default: Column, draw: Column, key: Column | None = None) -> Column:
        """The default where there is one, else a sample."""
        return F.coalesce(default, self.sample(draw, key))


class Resolvers:
    """Sources of external selections by name: each gives a table (value, label)."""

    def __init__(self) -> None:
        self._of: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, source: Callable[[SparkSession], DataFrame]) -> None:
        self._of[name] = source

    def values(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._of:
            raise KeyError(f"no resolver {name!r}")
        return self._of[name](spark).select("value", "label").distinct()


def satisfiable(domain: Domain, constraint: Constraint, spark: SparkSession) -> bool:
    """Whether a boundary value or one of eight fixed samples satisfies the constraint (a heuristic probe)."""
    probes = list(domain.boundaries())
    if domain.kind in ("integer", "double"):
        step = (i / 8 for i in range(8))
        probes += [type(probes[0])(probes[0] + (probes[-1] - probes[0]) * s) for s in step]
    if domain.kind == "selection":
        probes = [[p] for p in probes] + [list(domain.values[: domain.most])]
    if not probes:
        return False
    one = spark.range(1).select(F.array(*[F.array(*[F.lit(x) for x in p]) if isinstance(p, list) else F.lit(p) for p in probes]).alias("p"))
    return bool(one.select(F.exists("p", lambda v: compile_constraint(constraint, v))).first()[0])
