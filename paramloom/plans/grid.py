"""Trial grids: mixed-radix enumeration of axes on spark.range (no cross joins), codes, orderings, samples."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import closure
from ..operators.ranking import numbered, running
from ..sources.shared import written


@dataclass(frozen=True)
class Axis:
    element: str
    parameter: str
    values: tuple
    edges: tuple | None = None

    def boundaries(self) -> tuple:
        return self.edges if self.edges is not None else tuple(dict.fromkeys((self.values[0], self.values[-1])))

    def index_of(self, value: Column) -> Column:
        """Place of a value on the axis, or null."""
        return F.nullif(F.array_position(F.array(*[F.lit(v) for v in self.values]), value), F.lit(0).cast("bigint")) - 1

    def contains(self, value: Column) -> Column:
        return F.coalesce(self.index_of(value).isNotNull(), F.lit(False))


def reordered(axes: list, order: list[tuple[str, str]]) -> list:
    """The axes in another order, which must name each of them once."""
    of = {(a.element, a.parameter): a for a in axes}
    if len(order) != len(axes) or set(order) != set(of):
        raise ValueError("not an order of these axes")
    return [of[t] for t in order]


def resolve_tokens(values: DataFrame, tokens: DataFrame, column: str = "value") -> DataFrame:
    """values with single-key tokens `${key}` replaced by tokens (key, text); unknown keys and richer texts give null
    where they are tokens, other values stay."""
    key = F.regexp_extract(column, r"^\$\{([^${}]+)\}$", 1)
    is_token = F.startswith(F.col(column), F.lit("${")) & F.endswith(F.col(column), F.lit("}"))
    out = values.withColumn("_key", key).join(tokens.select(F.col("key").alias("_key"), F.col("text").alias("_text")), "_key", "left")
    return out.withColumn(column, F.when(is_token, F.col("_text")).otherwise(F.col(column))).select(*values.columns)


def validate(axes: list[Axis], bound: set[tuple[str, str]] = frozenset()) -> list[str]:
    """Everything that is wrong with the axes."""
    found = []
    targets = [(a.element, a.parameter) for a in axes]
    for a, t in zip(axes, targets):
        name = ".".join(t)
        if not a.values:
            found.append(f"{name}: no values")
        if len(set(a.values)) != len(a.values):
            found.append(f"{name}: repeated values")
        if a.edges is not None and not set(a.edges) <= set(a.values):
            found.append(f"{name}: boundary values outside the axis")
        if targets.count(t) > 1:
            found.append(f"{name}: target of several axes")
        if t in bound:
            found.append(f"{name}: both axis and binding")
    return list(dict.fromkeys(found))


def strides(sizes: list[int]) -> list[int]:
    return [prod(sizes[i + 1 :]) for i in range(len(sizes))]


def width(sizes: list[int]) -> int:
    """Hex digits per axis: enough for the largest offset, at least 2 above 16 values."""
    top = max(sizes, default=1)
    return 1 if top <= 16 else max(2, len(f"{top - 1:x}"))


def offsets(trial: Column, sizes: list[int]) -> list[Column]:
    return [F.pmod(F.call_function("div", trial, F.lit(s).cast("bigint")), F.lit(c).cast("bigint")) if c else F.lit(0).cast("bigint") for s, c in zip(strides(sizes), sizes)]


def index(digits: list[Column], sizes: list[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for d, s in zip(digits, strides(sizes)):
        out = out + d * F.lit(s)
    return out


def code(digits: list[Column], sizes: list[int]) -> Column:
    w = width(sizes)
    return F.concat(F.lit("0x"), *[F.lpad(F.lower(F.hex(d)), w, "0") for d in digits])


def enumerate_grid(spark: SparkSession, axes: list[Axis]) -> DataFrame:
    """trial, code, o0.. (offsets), v0.. (values); no axes make one trial. Refuses more than 2^63 - 1 trials."""
    sizes = [len(a.values) for a in axes]
    n = max(1, prod(sizes))
    if n >= 1 << 63:
        raise ValueError(f"{n} trials")
    digits = offsets(F.col("trial"), sizes)
    trials = spark.range(n).withColumnRenamed("id", "trial").withColumns({"code": code(digits, sizes), **{f"o{i}": d for i, d in enumerate(digits)}})
    return trials.withColumns({f"v{i}": F.get(F.array(*[F.lit(v) for v in a.values]), F.col(f"o{i}").cast("int")) for i, a in enumerate(axes)})


@dataclass(frozen=True)
class TableAxis:
    """An axis whose values are rows: table (place from 0, value) of `size` rows."""

    element: str
    parameter: str
    table: DataFrame
    size: int

    @classmethod
    def of(cls, element: str, parameter: str, values: Column, rows: DataFrame) -> TableAxis:
        """The distinct values of rows in ascending order; nulls are no values."""
        table = written(numbered(rows.select(values.alias("value")).where("value is not null").distinct(), F.col("value"), name="place"), "axis")
        return cls(element, parameter, table, table.count())


def enumerate_tables(spark: SparkSession, axes: list[TableAxis]) -> DataFrame:
    """enumerate_grid() of axes in tables: trial, code, o0.., v0... Trials come from a range; their digits are joined to
    each axis by place, so no axis is multiplied with another."""
    sizes = [a.size for a in axes]
    n = prod(sizes) if axes else 1
    if n >= 1 << 63:
        raise ValueError(f"{n} trials")
    digits = offsets(F.col("trial"), sizes)
    out = spark.range(n).withColumnRenamed("id", "trial").withColumns({"code": code(digits, sizes) if axes else F.lit("0x"), **{f"o{i}": d for i, d in enumerate(digits)}})
    for i, a in enumerate(axes):
        out = out.join(a.table.select(F.col("place").alias(f"o{i}"), F.col("value").alias(f"v{i}")), f"o{i}")
    return out.select("trial", "code", *[f"o{i}" for i in range(len(axes))], *[f"v{i}" for i in range(len(axes))])


def assignments(trials: DataFrame, axes: list[Axis] | list[TableAxis]) -> DataFrame:
    """Long form: (trial, element, parameter, value as text)."""
    rows = [F.struct(F.lit(a.element).alias("element"), F.lit(a.parameter).alias("parameter"), F.col(f"v{i}").cast("string").alias("value")) for i, a in enumerate(axes)]
    return trials.select("trial", F.explode(F.array(*rows)).alias("a")).select("trial", "a.*")


def order(trials: DataFrame, axes: list[Axis] | list[TableAxis], how: str, seed: str = "0", cost: Column | None = None) -> DataFrame:
    """trials with `position`: sequential, shuffled (by hash), edge_first (most boundary values first), cost."""
    at_edge = lambda i, a: F.col(f"o{i}").isin(0, a.size - 1) if isinstance(a, TableAxis) else F.col(f"v{i}").isin(list(a.boundaries()))
    edge = sum((at_edge(i, a).cast("int") for i, a in enumerate(axes)), F.lit(0))
    keys = {"sequential": [], "shuffled": [F.md5(F.concat(F.lit(seed + ":"), F.col("trial").cast("string")))], "edge_first": [-F.col("edges")], "cost": [cost if cost is not None else F.lit(0)]}[how]
    return numbered(trials.withColumn("edges", edge), *keys, F.col("trial"))


def sample(spark: SparkSession, total: int, how: str, count: int, seed: str = "0") -> DataFrame:
    """Trial numbers of a grid of `total`: grid (all), random (hash order), linspace (evenly spread, ends included)."""
    if count < 1:
        raise ValueError("a sample has at least one trial")
    if how == "grid":
        return spark.range(total).withColumnRenamed("id", "trial")
    if how == "random":
        return spark.range(total).withColumnRenamed("id", "trial").orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col("trial").cast("string"))), "trial").limit(count)
    count = min(count, total)
    spot = F.lit(0) if count == 1 else F.call_function("div", F.col("id") * F.lit(total - 1), F.lit(count - 1).cast("bigint"))
    return spark.range(count).select(spot.cast("bigint").alias("trial")).distinct()


def binding_levels(elements: DataFrame, links: DataFrame) -> DataFrame:
    """elements (pos, element, axes), links (src, dst, kind): own level is the running number of axes in authored
    order; the effective one is the largest over shared, exclusive and linear dependencies (src needs dst)."""
    own = written(running(elements, {"own": F.col("axes")}, F.col("pos")), "levels")
    level = own.select("element", F.col("own").alias("level"))
    carry = links.where(F.col("kind").isin("shared", "exclusive", "linear")).select(F.col("src").alias("element"), "dst")
    # the largest own level among all that an element needs, directly or not
    up = closure(carry.select(F.col("element").alias("src"), "dst")).join(level.withColumnRenamed("element", "dst"), "dst").groupBy(F.col("src").alias("element")).agg(F.max("level").alias("up"))
    return own.join(up, "element", "left").select("element", "own", F.greatest("own", F.coalesce("up", "own")).alias("effective"))


def _level(table: DataFrame, name: str, tokens: DataFrame | None) -> DataFrame:
    """(element, parameter, name): a level's values, tokens `${key}` replaced by what tokens (key, parameter, text) has
    for the key and the parameter, else for the key and any parameter (null); tokens without an answer give null."""
    rows = table.select("element", "parameter", F.col("value").alias(name))
    if tokens is None:
        return rows
    key = F.regexp_extract(name, r"^\$\{([^${}]+)\}$", 1)
    is_token = F.startswith(F.col(name), F.lit("${")) & F.endswith(F.col(name), F.lit("}"))
    own = tokens.where("parameter is not null").select(F.col("key").alias("_key"), "parameter", F.col("text").alias("_own"))
    every = tokens.where("parameter is null").select(F.col("key").alias("_key"), F.col("text").alias("_every"))
    out = rows.withColumn("_key", key).join(own, ["_key", "parameter"], "left").join(every, "_key", "left")
    return out.select("element", "parameter", F.when(is_token, F.coalesce("_own", "_every")).otherwise(F.col(name)).alias(name))


def resolve(needed: DataFrame, axis: DataFrame, bindings: DataFrame, configs: DataFrame, defaults: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """needed (trial, element, parameter) with value and source: axis, then binding, configuration, default, unresolved.

    With tokens, a binding, configuration or default that is a token counts by what it resolves to for its parameter; one
    that resolves to nothing lets the next level answer."""
    out = needed.join(axis.withColumnRenamed("value", "_axis"), ["trial", "element", "parameter"], "left")
    for table, name in ((bindings, "_binding"), (configs, "_config"), (defaults, "_default")):
        out = out.join(_level(table, name, tokens), ["element", "parameter"], "left")
    source = F.when(F.col("_axis").isNotNull(), "axis").when(F.col("_binding").isNotNull(), "binding").when(F.col("_config").isNotNull(), "config").when(F.col("_default").isNotNull(), "default").otherwise("unresolved")
    return out.select("trial", "element", "parameter", F.coalesce("_axis", "_binding", "_config", "_default").alias("value"), source.alias("source"))


def axis_boundaries(values: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(axis, value) of every axis: its explicit edges (axis, value) where it has some, else its first and last value by
    values (axis, place, value)."""
    ends = values.groupBy("axis").agg(F.min_by("value", "place").alias("first"), F.max_by("value", "place").alias("last"))
    ends = ends.select("axis", F.explode(F.array_distinct(F.array("first", "last"))).alias("value"))
    if edges is None:
        return ends
    return ends.join(edges.select("axis").distinct(), "axis", "left_anti").unionByName(edges.select("axis", "value").distinct())


def axis_problems(axes: DataFrame, values: DataFrame, edges: DataFrame, parameters: DataFrame, bindings: DataFrame) -> DataFrame:
    """(axis, problem) of many axes at once: axes (axis, element, parameter), values and edges (axis, kind, value),
    parameters (element, parameter, kind, derived), bindings (element, parameter)."""
    problem = lambda rows, text: rows.select("axis", F.lit(text).alias("problem")).distinct()
    target = ["element", "parameter"]
    known = axes.join(parameters, target, "left")
    kinds = values.join(known.select("axis", F.col("kind").alias("_kind")), "axis")
    names = axes.groupBy("axis").count().where("count > 1")
    targets = axes.groupBy(*target).agg(F.count_distinct("axis").alias("n")).where("n > 1")
    found = [
        problem(axes.join(values, "axis", "left_anti"), "no values"),
        problem(values.groupBy("axis", "value").count().where("count > 1"), "repeated values"),
        problem(edges.join(values.select("axis", "value"), ["axis", "value"], "left_anti"), "boundary values outside the axis"),
        problem(names, "name of several axes"),
        problem(axes.join(targets, target, "left_semi"), "target of several axes"),
        problem(known.where("kind is null"), "unknown parameter"),
        problem(known.where("derived"), "derived parameter"),
        problem(kinds.where("kind <> _kind"), "values of another kind"),
        problem(axes.join(bindings.select(*target), target, "left_semi"), "both axis and binding"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def group_size(level: int, sizes: list[int]) -> int:
    """Trials that share an instance at a binding level."""
    return max(1, prod(sizes)) if level <= 0 else 1 if level >= len(sizes) else strides(sizes)[level - 1]
