"""Constraints as data: postfix programs in rows, and one plan that checks any number of them.

A program is an array of steps; a step is a leaf test, always, never, or and / or / not over the results of the steps
before it. A row's program runs on a stack of booleans in one aggregate() expression, so a table of millions of
(parameter, constraint, value) rows needs no plan of its own for any constraint. Values are structs of one field a kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constraints import Constraint

#: op, and by need: integers, doubles, texts; n: how many results `and` and `or` take
STEP = "struct<op:string,ints:array<bigint>,nums:array<double>,texts:array<string>,n:int>"
VALUE = "struct<int:bigint,num:double,bool:boolean,str:string,sel:array<string>>"
#: a parameter's domain: bounds or a list for integers, bounds for doubles, a pattern, items and their most, or external items
DOMAIN = "struct<int_low:bigint,int_high:bigint,ints:array<bigint>,num_low:double,num_high:double,pattern:string,items:array<string>,most:int,external:boolean>"
#: probes of a domain between its boundaries, and the text that fixes them
SAMPLES, SEED = 8, "probe"


def steps(c: Constraint) -> list[tuple]:
    """A constraint's program, as rows of STEP."""
    if c.op in ("and", "or", "not"):
        return [s for x in c.args for s in steps(x)] + [(c.op, None, None, None, len(c.args))]
    if c.op in ("always", "never"):
        return [(c.op, None, None, None, 0)]
    ints, nums, texts = None, None, None
    if c.kind == "double":
        nums = [float(a) for a in c.args]
    elif c.args and isinstance(c.args[0], str) or c.kind == "selection" and c.op not in ("min_size", "max_size"):
        texts = list(c.args)
    else:
        ints = [int(a) for a in c.args]
    return [(c.op, ints, nums, texts, 0)]


def table(spark: SparkSession, constraints: list[tuple[str, str, Constraint]]) -> DataFrame:
    """(parameter, constraint, kind, program) of constraints written in Python."""
    return spark.createDataFrame([(p, name, c.kind, steps(c)) for p, name, c in constraints], f"parameter string, constraint string, kind string, program array<{STEP}>")


def step(op: str, ints: list | None = None, nums: list | None = None, texts: list | None = None, n: int = 0) -> Column:
    """A step whose arguments are columns."""
    array = lambda given, kind: F.array(*given).cast(f"array<{kind}>") if given is not None else F.lit(None).cast(f"array<{kind}>")
    return F.struct(F.lit(op).alias("op"), array(ints, "bigint").alias("ints"), array(nums, "double").alias("nums"), array(texts, "string").alias("texts"), F.lit(n).alias("n"))


def _leaf(s: Column, kind: Column, v: Column) -> Column:
    """A leaf's result; null where a value or an argument is missing."""
    i, x, t, p = v["int"], v["num"], v["str"], v["sel"]
    ints, nums, texts = s["ints"], s["nums"], s["texts"]
    first, second = F.get(ints, F.lit(0)), F.get(ints, F.lit(1))
    low, high = F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
    size, none = F.size(p), F.array().cast("array<string>")
    is_ = lambda k, op: (kind == k) & (s["op"] == op)
    cases = [
        (is_("integer", "min"), i >= first), (is_("integer", "max"), i <= first), (is_("integer", "range"), i.between(first, second)),
        (is_("integer", "in_set"), F.array_contains(ints, i)), (is_("integer", "not_in_set"), ~F.array_contains(ints, i)),
        (is_("integer", "multiple"), F.when(first == 0, F.lit(False)).otherwise(F.try_mod(i, first) == 0)),
        (is_("double", "min"), x >= low), (is_("double", "max"), x <= low), (is_("double", "range"), x.between(low, high)),
        (is_("boolean", "eq_to"), v["bool"] == (first == 1)),
        (is_("string", "regex"), F.rlike(t, F.get(texts, F.lit(0)))), (is_("string", "length_range"), F.octet_length(t).between(first, second)),
        (is_("string", "non_empty"), F.octet_length(t) > 0), (is_("string", "in_set"), F.array_contains(texts, t)), (is_("string", "not_in_set"), ~F.array_contains(texts, t)),
        (is_("selection", "require_all"), F.size(F.array_except(texts, p)) == 0), (is_("selection", "require_any"), F.size(F.array_intersect(texts, p)) > 0),
        (is_("selection", "forbid_all"), F.size(F.array_intersect(F.coalesce(texts, none), p)) == 0),
        (is_("selection", "min_size"), size >= first), (is_("selection", "max_size"), size <= first), (s["op"].isin("always", "never"), s["op"] == "always"),
    ]
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), F.lit(None).cast("boolean"))


def holds(program: Column, kind: Column, value: Column) -> Column:
    """Whether a value (a struct like VALUE) of the constraint's kind satisfies a program: two-valued.

    A null value satisfies nothing, NaN satisfies no double constraint; an unknown test is not satisfied."""

    def run(stack: Column, s: Column) -> Column:
        depth = F.size(stack)
        taken = F.slice(stack, depth - s["n"] + 1, s["n"])
        rest = F.slice(stack, F.lit(1), depth - s["n"])
        both = F.when(s["op"] == "and", F.forall(taken, lambda b: b)).otherwise(F.exists(taken, lambda b: b))
        flipped = F.concat(F.slice(stack, F.lit(1), depth - 1), F.array(~F.element_at(stack, -1)))
        leaf = F.concat(stack, F.array(F.coalesce(_leaf(s, kind, value), F.lit(False))))
        return F.when(s["op"].isin("and", "or"), F.concat(rest, F.array(both))).when(s["op"] == "not", flipped).otherwise(leaf)

    end = F.get(F.aggregate(program, F.array().cast("array<boolean>"), run), F.lit(0))
    given = F.coalesce(value["int"].cast("string"), value["num"].cast("string"), value["bool"].cast("string"), value["str"], F.when(value["sel"].isNotNull(), "")).isNotNull()
    return F.coalesce(end & given & ~((kind == "double") & F.isnan(value["num"])), F.lit(False))


def in_domain(kind: Column, domain: Column, value: Column) -> Column:
    """Whether a value is in its parameter's domain: two-valued. Any text without a pattern; external items by size only."""
    i, x, sel = value["int"], value["num"], value["sel"]
    listed = F.when(domain["ints"].isNotNull(), F.array_contains(domain["ints"], i)).otherwise(i.between(domain["int_low"], domain["int_high"]))
    number = x.between(domain["num_low"], domain["num_high"]) & ~F.isnan(x)
    text = F.when(domain["pattern"].isNotNull(), F.rlike(value["str"], domain["pattern"])).otherwise(value["str"].isNotNull())
    fits = F.size(sel) <= F.coalesce(domain["most"], F.lit((1 << 31) - 1))
    known = F.coalesce(domain["external"], F.lit(False)) | (F.size(F.array_except(sel, F.coalesce(domain["items"], F.array().cast("array<string>")))) == 0)
    found = F.when(kind == "integer", listed).when(kind == "double", number).when(kind == "boolean", value["bool"].isNotNull()).when(kind == "string", text).when(kind == "selection", fits & known)
    return F.coalesce(found, F.lit(False))


def validate(values: DataFrame, parameters: DataFrame, constraints: DataFrame) -> DataFrame:
    """values (parameter, kind, value, ...) with `violations`, all of them: `unknown parameter`; `kind mismatch` alone;
    else `not in domain` and `constraint c` for each constraint of the parameter that fails, by name.

    parameters (parameter, kind, domain), constraints (parameter, constraint, kind, program). A parameter's constraints
    are gathered into one row, so values are joined once and never multiplied."""
    own = constraints.groupBy("parameter").agg(F.array_sort(F.collect_list(F.struct("constraint", F.col("kind").alias("of"), "program"))).alias("_constraints"))
    known = parameters.join(own, "parameter", "left").select("parameter", F.col("kind").alias("_kind"), F.col("domain").alias("_domain"), "_constraints")
    v = values.join(known, "parameter", "left")
    failing = F.filter(F.coalesce("_constraints", F.array().cast(f"array<struct<constraint:string,of:string,program:array<{STEP}>>>")), lambda c: ~((c["of"] == F.col("_kind")) & holds(c["program"], F.col("_kind"), F.col("value"))))
    domain = F.when(~in_domain(F.col("_kind"), F.col("_domain"), F.col("value")), F.array(F.lit("not in domain"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(domain, F.transform(failing, lambda c: F.concat(F.lit("constraint "), c["constraint"])))
    found = F.when(F.col("_kind").isNull(), F.array(F.lit("unknown parameter"))).when(~F.col("kind").eqNullSafe(F.col("_kind")), F.array(F.lit("kind mismatch"))).otherwise(found)
    return v.withColumn("violations", found).drop("_kind", "_domain", "_constraints")


def _value(int=None, num=None, bool=None, str=None, sel=None) -> Column:
    parts = {"int": (int, "bigint"), "num": (num, "double"), "bool": (bool, "boolean"), "str": (str, "string"), "sel": (sel, "array<string>")}
    return F.struct(*[(F.lit(None) if c is None else c).cast(t).alias(n) for n, (c, t) in parts.items()])


def satisfiable(parameters: DataFrame, constraints: DataFrame) -> DataFrame:
    """(parameter, constraint, satisfiable): whether a probe of the domain satisfies a constraint of its kind.

    Probes are the domain's boundaries and, for numbers, SAMPLES values fixed by the parameter's name; texts are probed
    by the empty one, selections by their first and last item. A heuristic: true is certain, false is not."""
    d = F.col("domain")
    draw = lambda k: F.pmod(F.xxhash64(F.lit(SEED), "parameter", F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    low, high = F.coalesce(F.array_min(d["ints"]), d["int_low"]), F.coalesce(F.array_max(d["ints"]), d["int_high"])
    inner = lambda k: F.coalesce(F.get(d["ints"], F.floor(draw(k) * F.size(d["ints"])).cast("int")), low + F.floor(draw(k) * (high - low + 1)).cast("long"))
    integers = F.array(_value(int=low), _value(int=high), *[_value(int=inner(k)) for k in range(SAMPLES)])
    doubles = F.array(_value(num=d["num_low"]), _value(num=d["num_high"]), *[_value(num=d["num_low"] + draw(k) * (d["num_high"] - d["num_low"])) for k in range(SAMPLES)])
    ends = F.array(F.get(d["items"], F.lit(0)), F.try_element_at(d["items"], F.lit(-1)))
    items = F.transform(F.when(F.coalesce(d["external"], F.lit(False)), F.array().cast("array<string>")).otherwise(F.array_compact(ends)), lambda x: _value(sel=F.array(x)))
    kind = F.col("kind")
    probes = F.when(kind == "integer", integers).when(kind == "double", doubles).when(kind == "boolean", F.array(_value(bool=F.lit(False)), _value(bool=F.lit(True)))).when(kind == "string", F.array(_value(str=F.lit("")))).when(kind == "selection", items)
    c = constraints.select("parameter", "constraint", F.col("kind").alias("_of"), "program")
    fits = F.exists(F.coalesce(probes, F.array().cast(f"array<{VALUE}>")), lambda v: holds(F.col("program"), kind, v))
    return parameters.join(c, "parameter").select("parameter", "constraint", (fits & (F.col("_of") == kind)).alias("satisfiable"))
