"""Typed scalar expressions: an AST with a strict checker that compiles to Spark columns.

No implicit int/double coercion; integer arithmetic wraps at 64 bits; doubles follow IEEE (also on division by
zero); equality of NaN is false; rounding is half to even and saturates at the bounds of a long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("integer", "double", "boolean", "string")
NAN = float("nan")


class ExpressionError(ValueError):
    """A kind, arity or name that the language does not allow."""


@dataclass(frozen=True)
class Expr:
    def __add__(self, other):
        return Binary("+", self, lift(other))

    def __sub__(self, other):
        return Binary("-", self, lift(other))

    def __mul__(self, other):
        return Binary("*", self, lift(other))

    def __truediv__(self, other):
        return Binary("/", self, lift(other))

    def __mod__(self, other):
        return Binary("%", self, lift(other))

    def __lt__(self, other):
        return Binary("<", self, lift(other))

    def __le__(self, other):
        return Binary("<=", self, lift(other))

    def __gt__(self, other):
        return Binary(">", self, lift(other))

    def __ge__(self, other):
        return Binary(">=", self, lift(other))

    def eq(self, other):
        return Binary("==", self, lift(other))

    def ne(self, other):
        return Binary("!=", self, lift(other))

    def __and__(self, other):
        return Binary("&&", self, lift(other))

    def __or__(self, other):
        return Binary("||", self, lift(other))

    def __invert__(self):
        return Unary("!", self)

    def __neg__(self):
        return Unary("-", self)


@dataclass(frozen=True)
class Literal(Expr):
    value: int | float | bool | str


@dataclass(frozen=True)
class Ref(Expr):
    name: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Call(Expr):
    function: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class If(Expr):
    condition: Expr
    then: Expr
    otherwise: Expr


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


def kind_of_value(x) -> str:
    return "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "double" if isinstance(x, float) else "string"


def check(e: Expr, schema: dict[str, str]) -> str:
    """The kind of an expression, or ExpressionError. schema: parameter name -> kind."""
    if isinstance(e, Literal):
        return kind_of_value(e.value)
    if isinstance(e, Ref):
        if schema.get(e.name) not in KINDS:
            raise ExpressionError(f"unknown or non-scalar parameter {e.name!r}")
        return schema[e.name]
    if isinstance(e, If):
        if check(e.condition, schema) != "boolean":
            raise ExpressionError("a condition must be boolean")
        a, b = check(e.then, schema), check(e.otherwise, schema)
        if a != b:
            raise ExpressionError(f"branches of kinds {a} and {b}")
        return a
    if isinstance(e, Unary):
        k = check(e.operand, schema)
        if (e.op == "!") != (k == "boolean") or (e.op == "-" and k not in ("integer", "double")):
            raise ExpressionError(f"{e.op} of {k}")
        return k
    if isinstance(e, Binary):
        a, b = check(e.left, schema), check(e.right, schema)
        if a != b:
            raise ExpressionError(f"{a} {e.op} {b}")
        numbers = ("integer", "double")
        allowed = {"+": numbers, "-": numbers, "*": numbers, "/": numbers, "%": ("integer",), "<": numbers, "<=": numbers, ">": numbers, ">=": numbers, "&&": ("boolean",), "||": ("boolean",), "==": KINDS, "!=": KINDS}
        if e.op not in allowed or a not in allowed[e.op]:
            raise ExpressionError(f"{a} {e.op} {b}")
        return a if e.op in "+-*/%" else "boolean"
    if isinstance(e, Call):
        kinds = [check(x, schema) for x in e.args]
        one = {"ceil": ("double", "integer"), "floor": ("double", "integer"), "round": ("double", "integer"), "len": ("string", "integer")}
        if e.function in one and kinds == [one[e.function][0]]:
            return one[e.function][1]
        if e.function == "abs" and len(kinds) == 1 and kinds[0] in ("integer", "double"):
            return kinds[0]
        if e.function == "pow" and kinds == ["double", "double"]:
            return "double"
        if e.function in ("min", "max") and len(kinds) >= 2 and len(set(kinds)) == 1 and kinds[0] in ("integer", "double"):
            return kinds[0]
        raise ExpressionError(f"{e.function}({', '.join(kinds)})")
    raise ExpressionError(f"not an expression: {e!r}")


def _wrap(x: Column) -> Column:
    """A decimal(38,0) to a 64-bit integer that wraps."""
    two64, two63 = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(x + two63, two64) - two63).cast("bigint")


def _big(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def saturate(x: Column) -> Column:
    """A whole double to a long: NaN is 0, values beyond the range stop at its bounds."""
    return (
        F.when(F.isnan(x), F.lit(0))
        .when(x >= F.lit(9.223372036854775807e18), F.lit((1 << 63) - 1))
        .when(x <= F.lit(-9.223372036854775808e18), F.lit(-(1 << 63)))
        .otherwise(x.cast("bigint"))
        .cast("bigint")
    )


def _negative_zero(x: Column) -> Column:
    return (x == 0) & (x.cast("string") == "-0.0")


def _divide(a: Column, b: Column) -> Column:
    up, down = F.lit(float("inf")), F.lit(float("-inf"))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) != _negative_zero(b), up).otherwise(down)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _less(a: Column, b: Column) -> Column:
    """Total order of doubles: -0.0 before 0.0, NaN (of which there is one) last."""
    return (a < b) | ((a == 0) & (b == 0) & _negative_zero(a) & ~_negative_zero(b))


def _extreme(function, args: list[Column]) -> Column:
    """least or greatest of doubles that passes over NaN operands."""
    clean = [F.when(~F.isnan(a), a) for a in args]
    return F.coalesce(function(*clean), F.lit(NAN))


def compile_expr(e: Expr, schema: dict[str, str], columns: dict[str, Column] | None = None) -> Column:
    """The column of a checked expression; columns gives those of parameters (default: by name)."""
    check(e, schema)
    col = lambda n: (columns or {}).get(n, F.col(n))

    def go(e: Expr) -> Column:
        kind = check(e, schema)
        if isinstance(e, Literal):
            return F.lit(e.value).cast("bigint") if kind == "integer" else F.lit(e.value)
        if isinstance(e, Ref):
            return col(e.name)
        if isinstance(e, If):
            return F.when(go(e.condition), go(e.then)).otherwise(go(e.otherwise))
        if isinstance(e, Unary):
            x = go(e.operand)
            return ~x if e.op == "!" else _wrap(F.lit(0).cast("decimal(38,0)") - _big(x)) if kind == "integer" else -x
        if isinstance(e, Binary):
            a, b, of = go(e.left), go(e.right), check(e.left, schema)
            if e.op in "+-*" and of == "integer":
                x, y = _big(a), _big(b)
                return _wrap((x + y if e.op == "+" else x - y if e.op == "-" else x * y).cast("decimal(38,0)"))
            if e.op == "/":
                zero = F.raise_error(F.lit("division by zero")).cast("bigint")
                return F.when(b == 0, zero).otherwise(_wrap(F.expr("cast(0 as decimal(38,0))") + F.call_function("div", a, b).cast("decimal(38,0)"))) if of == "integer" else _divide(a, b)
            if e.op == "%":
                return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(F.try_mod(a, b))
            if e.op in ("==", "!=") and of == "double":
                same = (a == b) & ~F.isnan(a)
                return same if e.op == "==" else ~same
            if of == "double" and e.op in ("<", "<=", ">", ">="):
                return {"<": lambda: _less(a, b), "<=": lambda: ~_less(b, a), ">": lambda: _less(b, a), ">=": lambda: ~_less(a, b)}[e.op]()
            table = {"+": a + b, "-": a - b, "*": a * b} if of == "double" and e.op in "+-*" else {}
            if e.op in table:
                return table[e.op]
            return {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b, "&&": lambda: a & b, "||": lambda: a | b}[e.op]()
        args = [go(x) for x in e.args]
        if e.function in ("ceil", "floor", "round"):
            x = args[0]
            whole = F.rint(x) if e.function == "round" else None
            if whole is None:  # Spark's own ceil and floor give longs; keep doubles until saturation
                near = F.rint(x)
                whole = F.when((near < x) if e.function == "ceil" else (near > x), near + (1 if e.function == "ceil" else -1)).otherwise(near)
            return saturate(whole)
        if e.function in ("min", "max"):
            f = F.least if e.function == "min" else F.greatest
            return _extreme(f, args) if kind == "double" else f(*args)
        if e.function == "abs":
            return F.when(args[0] < 0, _wrap(F.lit(0).cast("decimal(38,0)") - _big(args[0]))).otherwise(args[0]) if kind == "integer" else F.abs(args[0])
        return F.pow(*args) if e.function == "pow" else F.octet_length(args[0]).cast("bigint")

    return go(e)


def derive(df, name: str, kind: str, e: Expr, schema: dict[str, str]):
    """df with a derived parameter; its declared kind must be the expression's."""
    found = check(e, schema)
    if found != kind:
        raise ExpressionError(f"derived parameter {name!r} is declared {kind}, its expression is {found}")
    return df.withColumn(name, compile_expr(e, schema))
