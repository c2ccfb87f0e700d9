"""Predicate algebra over parameter values: compiled columns, a canonical form, and fingerprints."""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: leaf names by kind
LEAVES = {
    "integer": {"min", "max", "range", "in_set", "not_in_set", "multiple"},
    "double": {"min", "max", "range"},
    "boolean": {"eq_to"},
    "string": {"regex", "length_range", "non_empty", "in_set", "not_in_set"},
    "selection": {"require_all", "require_any", "forbid_all", "min_size", "max_size"},
}


@dataclass(frozen=True)
class Constraint:
    """op: a leaf of the kind, or always, never, and, or, not; args: leaf values or children."""

    kind: str
    op: str
    args: tuple = ()

    def __and__(self, other: Constraint) -> Constraint:
        return Constraint(self.kind, "and", (*(self.args if self.op == "and" else (self,)), *(other.args if other.op == "and" else (other,))))

    def __or__(self, other: Constraint) -> Constraint:
        return Constraint(self.kind, "or", (*(self.args if self.op == "or" else (self,)), *(other.args if other.op == "or" else (other,))))

    def __invert__(self) -> Constraint:
        return Constraint(self.kind, "not", (self,))


def leaf(kind: str, op: str, *args) -> Constraint:
    if op not in LEAVES[kind]:
        raise ValueError(f"{kind} constraints have no {op}")
    if kind == "double" and any(isinstance(a, float) and math.isnan(a) for a in args):
        raise ValueError("NaN bound")
    return Constraint(kind, op, tuple(args))


def compile_constraint(c: Constraint, value: Column) -> Column:
    """A two-valued predicate: null values satisfy nothing; NaN satisfies no double constraint at any node."""

    def go(c: Constraint) -> Column:
        a = c.args
        if c.op in ("always", "never"):
            return F.lit(c.op == "always")
        if c.op == "and":
            return reduce(lambda x, y: x & y, map(go, a), F.lit(True))
        if c.op == "or":
            return reduce(lambda x, y: x | y, map(go, a), F.lit(False))
        if c.op == "not":
            inner = ~F.coalesce(go(a[0]), F.lit(False))
            return inner & ~F.isnan(value) if c.kind == "double" else inner
        if c.op == "min":
            return value >= F.lit(a[0])
        if c.op == "max":
            return value <= F.lit(a[0])
        if c.op == "range":
            return value.between(F.lit(a[0]), F.lit(a[1]))
        if c.op in ("in_set", "not_in_set"):
            inside = value.isin(list(a)) if a else F.lit(False)
            return inside if c.op == "in_set" else ~inside
        if c.op == "multiple":
            return F.lit(False) if a[0] == 0 else value % F.lit(a[0]) == 0
        if c.op == "eq_to":
            return value == F.lit(a[0])
        if c.op == "regex":
            return value.rlike(a[0])
        if c.op == "length_range":
            return F.octet_length(value).between(a[0], a[1])
        if c.op == "non_empty":
            return F.octet_length(value) > 0
        items = F.array(*[F.lit(x) for x in a]) if a and isinstance(a[0], str) else F.array().cast("array<string>")
        if c.op == "require_all":
            return F.size(F.array_except(items, value)) == 0
        if c.op == "require_any":
            return F.arrays_overlap(items, value) if a else F.lit(False)
        if c.op == "forbid_all":
            return ~F.arrays_overlap(items, value) if a else F.lit(True)
        return F.size(value) >= a[0] if c.op == "min_size" else F.size(value) <= a[0]

    test = go(c) & ~F.isnan(value) if c.kind == "double" else go(c)
    return F.coalesce(test & value.isNotNull(), F.lit(False))


#: The tag byte of each operation, by kind, and the order in which they follow each other.
TAG_ORDER = {
    "integer": (0x10, "always never min max range in_set not_in_set multiple and or not"),
    "double": (0x20, "always never min max range and or not"),
    "boolean": (0x30, "always never eq_to not"),
    "string": (0x40, "always never regex length_range non_empty in_set not_in_set and or not"),
    "selection": (0x50, "always never require_all require_any forbid_all min_size max_size and or not"),
}
TAGS = {kind: {op: first + k for k, op in enumerate(ops.split())} for kind, (first, ops) in TAG_ORDER.items()}
_NAN = struct.pack("<Q", 0x7FF8_0000_0000_0000)


def encode(c: Constraint) -> bytes:
    """Canonical bytes: a tag, then little-endian arguments; texts and lists begin with their length, sets are sorted."""
    if c.op not in TAGS[c.kind]:
        raise ValueError(f"{c.kind} constraints have no {c.op}")
    text = lambda t: struct.pack("<I", len(t.encode())) + t.encode()
    number = (lambda x: _NAN if math.isnan(x) else struct.pack("<d", x)) if c.kind == "double" else (lambda x: struct.pack("<q", x))
    if c.op in ("and", "or"):
        body = struct.pack("<I", len(c.args)) + b"".join(map(encode, c.args))
    elif c.op == "not":
        body = encode(c.args[0])
    elif c.op in ("in_set", "not_in_set", "require_all", "require_any", "forbid_all"):
        distinct = set(c.args)
        body = struct.pack("<I", len(distinct)) + b"".join([text(t) for t in sorted(distinct, key=str.encode)] if c.kind != "integer" else map(number, sorted(distinct)))
    elif c.op == "eq_to":
        body = bytes([bool(c.args[0])])
    elif c.op in ("length_range", "min_size", "max_size"):
        body = struct.pack(f"<{len(c.args)}I", *c.args)
    else:
        body = b"".join(text(a) if isinstance(a, str) else number(a) for a in c.args)
    return bytes([TAGS[c.kind][c.op]]) + body


def canonical(c: Constraint) -> Constraint:
    """Children first: double negation, neutral and absorbing elements, flattening, order, repeats, lone children."""
    if c.op == "not":
        inner = canonical(c.args[0])
        if inner.op == "not":
            return inner.args[0]
        flip = {"always": "never", "never": "always"}
        # under a double constraint NaN fails both, so these stay equal on all other values
        return Constraint(c.kind, flip[inner.op]) if inner.op in flip else Constraint(c.kind, "not", (inner,))
    if c.op not in ("and", "or"):
        return c
    neutral, absorbing = ("always", "never") if c.op == "and" else ("never", "always")
    parts: dict[bytes, Constraint] = {}
    for x in map(canonical, c.args):
        for y in x.args if x.op == c.op else (x,):
            if y.op == absorbing:
                return Constraint(c.kind, absorbing)
            if y.op != neutral:
                parts[encode(y)] = y
    if not parts:
        return Constraint(c.kind, neutral)
    ordered = tuple(parts[k] for k in sorted(parts))
    return ordered[0] if len(ordered) == 1 else Constraint(c.kind, c.op, ordered)


def fingerprint(c: Constraint) -> str:
    """SHA-256 of the canonical form (64 hex digits)."""
    return hashlib.sha256(encode(canonical(c))).hexdigest()


def violations(checks: dict[str, Column]) -> Column:
    """Names of all checks that fail (a null check fails); none are skipped."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def test_typed(c: Constraint, kind: Column, value: Column) -> Column:
    """False where the value's kind is not the constraint's."""
    return F.when(kind == F.lit(c.kind), compile_constraint(c, value)).otherwise(F.lit(False))
