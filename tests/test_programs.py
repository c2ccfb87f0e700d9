"""Canonical bytes against struct.pack, programs against compiled constraints, validation of many parameters."""

import hashlib
import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from paramloom.functions import canonical
from paramloom.functions import constraints as C
from paramloom.functions import programs as P

DOUBLES = [0.0, -0.0, 1.0, -1.5, 0.1, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), math.pi, 1e22, 2.0**-1022, 2.0**-1023]


def test_doubles_have_their_bits(spark):
    rng = random.Random(2)
    more = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(DOUBLES + more)], "i int, x double").select("i", F.unhex(canonical.double_hex(F.col("x"))).alias("b"))
    want = [struct.pack("<d", x) if not math.isnan(x) else struct.pack("<Q", 0x7FF8 << 48) for x in DOUBLES + more]
    assert {r["i"]: bytes(r["b"]) for r in got.collect()} == dict(enumerate(want))


def test_values_and_trials(spark):
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    rows = [("integer", "n", -5, None, None, None, None), ("double", "x", None, float("nan"), None, None, None), ("boolean", "b", None, None, True, None, None), ("boolean", "b", None, None, None, None, None), ("string", "é", None, None, None, "ß漢", None), ("string", "s", None, None, None, "", None), ("selection", "v", None, None, None, None, ["b", "a", "é", "b"]), ("selection", "v", None, None, None, None, []), ("other", "o", 1, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, name string, int long, num double, bool boolean, str string, sel array<string>")
    cols = [F.col(c) for c in ("kind", "name", "int", "num", "bool", "str", "sel")]
    got = {r["i"]: r["b"] and bytes(r["b"]) for r in df.select("i", canonical.value_bytes(*cols).alias("b")).collect()}
    want = [b"\x01n\0" + struct.pack("<q", -5), b"\x02x\0" + struct.pack("<Q", 0x7FF8 << 48), b"\x03b\0\x01", None, b"\x04" + "é".encode() + b"\0" + text("ß漢"), b"\x04s\0" + text(""), b"\x05v\0" + struct.pack("<I", 3) + text("a") + text("b") + text("é"), b"\x05v\0" + struct.pack("<I", 0), None]
    assert got == dict(enumerate(want))
    h = lambda b: hashlib.sha256(b).hexdigest()
    a = spark.createDataFrame([(1, "db", "z", h(b"1")), (1, "db", "a", h(b"2")), (1, "Db", "q", h(b"3")), (2, "db", "a", h(b"2")), (2, "db", "a", h(b"2"))], "trial_id int, element string, parameter string, fingerprint string")
    got = {r["trial_id"]: bytes(r["bytes"]) for r in canonical.trial_bytes(a).collect()}
    raw = lambda b: hashlib.sha256(b).digest()
    one = b"\x60" + struct.pack("<I", 2) + text("Db") + struct.pack("<I", 1) + text("q") + raw(b"3") + text("db") + struct.pack("<I", 2) + text("a") + raw(b"2") + text("z") + raw(b"1")
    assert got == {1: one, 2: b"\x60" + struct.pack("<I", 1) + text("db") + struct.pack("<I", 1) + text("a") + raw(b"2")}


def test_constraint_bytes():
    i = lambda op, *a: C.leaf("integer", op, *a)
    assert C.encode(i("min", 3)) == b"\x12" + struct.pack("<q", 3)
    assert C.encode(i("in_set", 9, -1, 9)) == b"\x15" + struct.pack("<Iqq", 2, -1, 9)
    both = C.canonical(i("max", 1) & i("min", 3) & i("max", 1))
    assert C.encode(both) == b"\x18" + struct.pack("<I", 2) + C.encode(i("min", 3)) + C.encode(i("max", 1))
    assert C.encode(~C.leaf("double", "range", 0.5, 2.0)) == b"\x27\x24" + struct.pack("<dd", 0.5, 2.0)
    assert C.encode(C.leaf("boolean", "eq_to", True)) == b"\x32\x01" and C.encode(C.Constraint("boolean", "never")) == b"\x31"
    assert C.encode(C.leaf("string", "length_range", 1, 9)) == b"\x43" + struct.pack("<II", 1, 9) and C.encode(C.leaf("string", "non_empty")) == b"\x44"
    assert C.encode(C.leaf("selection", "forbid_all", "b", "a")) == b"\x54" + struct.pack("<II", 2, 1) + b"a" + struct.pack("<I", 1) + b"b"
    assert C.encode(C.leaf("selection", "max_size", 4)) == b"\x56" + struct.pack("<I", 4)
    with pytest.raises(ValueError):
        C.encode(C.Constraint("boolean", "and"))


LEAVES = {
    "integer": [("min", 2), ("max", 7), ("range", 1, 5), ("in_set", 1, 4), ("in_set",), ("not_in_set", 3), ("multiple", 3), ("multiple", 0)],
    "double": [("min", 2.0), ("max", 7.0), ("range", 1.5, 5.0)],
    "string": [("regex", "a.c"), ("length_range", 1, 3), ("non_empty",), ("in_set", "abc", ""), ("not_in_set", "é")],
    "selection": [("require_all", "a", "b"), ("require_all",), ("require_any", "a", "c"), ("require_any",), ("forbid_all", "c"), ("forbid_all",), ("min_size", 1), ("max_size", 1)],
    "boolean": [("eq_to", True), ("eq_to", False)],
}
VALUES = {"integer": ("int", [0, 1, 3, 4, 6, 9, None]), "double": ("num", [0.0, 2.0, 5.0, 9.0, float("nan"), None]), "string": ("str", ["", "abc", "é", "xaxc", None]), "selection": ("sel", [[], ["a"], ["a", "b"], ["c"], None]), "boolean": ("bool", [True, False, None])}


@pytest.mark.parametrize("kind", LEAVES)
def test_programs_equal_compiled_constraints(spark, kind):
    rng = random.Random(kind)
    made = [C.leaf(kind, *a) for a in LEAVES[kind]] + [C.Constraint(kind, "always"), C.Constraint(kind, "never")]
    for _ in range(18):
        if kind == "boolean":
            made.append(~rng.choice(made))
        else:
            made.append(rng.choice([lambda: ~rng.choice(made), lambda: rng.choice(made) & rng.choice(made), lambda: rng.choice(made) | rng.choice(made)])())
    if kind != "boolean":
        made += [C.Constraint(kind, "and"), C.Constraint(kind, "or"), ~C.Constraint(kind, "and")]
    name, values = VALUES[kind]
    empty = {"int": None, "num": None, "bool": None, "str": None, "sel": None}
    v = spark.createDataFrame([(i, empty | {name: x}) for i, x in enumerate(values)], f"i int, value {P.VALUE}")
    table = P.table(spark, [("p", str(k), c) for k, c in enumerate(made)])
    got = v.crossJoin(table).select("i", "constraint", P.holds(F.col("program"), F.col("kind"), F.col("value")).alias("ok")).collect()
    want = v.select("i", *[C.compile_constraint(c, F.col("value")[name]).alias(f"c{k}") for k, c in enumerate(made)]).collect()
    want = {(r["i"], str(k)): r[f"c{k}"] for r, k in itertools.product(want, range(len(made)))}
    assert {(r["i"], r["constraint"]): r["ok"] for r in got} == want


def test_validation_tells_all_violations(spark):
    d = lambda **k: tuple(k.get(n) for n in ("int_low", "int_high", "ints", "num_low", "num_high", "pattern", "items", "most", "external"))
    parameters = spark.createDataFrame([("n", "integer", d(int_low=0, int_high=9)), ("m", "integer", d(ints=[1, 5])), ("x", "double", d(num_low=0.0, num_high=1.0)), ("s", "string", d(pattern="^a")), ("t", "string", d()), ("v", "selection", d(items=["a", "b"], most=1)), ("w", "selection", d(external=True, most=2)), ("b", "boolean", d())], f"parameter string, kind string, domain {P.DOMAIN}")
    i = lambda op, *a: C.leaf("integer", op, *a)
    constraints = P.table(spark, [("n", "even", i("multiple", 2)), ("n", "big", i("min", 5) & ~i("in_set", 8)), ("x", "half", C.leaf("double", "max", 0.5)), ("s", "ten", C.leaf("integer", "min", 10)), ("b", "yes", C.leaf("boolean", "eq_to", True)), ("n", "far", i("min", 100)), ("w", "all", C.leaf("selection", "require_all", "q"))])
    e = lambda **k: tuple(k.get(n) for n in ("int", "num", "bool", "str", "sel"))
    rows = [("n", "integer", e(int=6), ["constraint far"]), ("n", "integer", e(int=11), ["not in domain", "constraint even", "constraint far"]), ("n", "integer", e(int=3), ["constraint big", "constraint even", "constraint far"]), ("n", "integer", e(), ["not in domain", "constraint big", "constraint even", "constraint far"]), ("n", "double", e(num=6.0), ["kind mismatch"]), ("n", None, e(), ["kind mismatch"]), ("q", "integer", e(int=1), ["unknown parameter"]), ("m", "integer", e(int=5), []), ("m", "integer", e(int=2), ["not in domain"]), ("x", "double", e(num=float("nan")), ["not in domain", "constraint half"]), ("x", "double", e(num=0.4), []), ("s", "string", e(str="ab"), ["constraint ten"]), ("t", "string", e(str=""), []), ("v", "selection", e(sel=["a"]), []), ("v", "selection", e(sel=["a", "b"]), ["not in domain"]), ("v", "selection", e(sel=["z"]), ["not in domain"]), ("w", "selection", e(sel=["q", "r"]), []), ("w", "selection", e(sel=["r"]), ["constraint all"]), ("b", "boolean", e(bool=False), ["constraint yes"])]
    values = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], f"k int, parameter string, kind string, value {P.VALUE}")
    got = P.validate(values, parameters, constraints)
    assert {r["k"]: r["violations"] for r in got.collect()} == {k: sorted(r[3], key=lambda x: x != "not in domain") for k, r in enumerate(rows)}
    assert got.columns == ["parameter", "k", "kind", "value", "violations"]
    found = {(r["parameter"], r["constraint"]): r["satisfiable"] for r in P.satisfiable(parameters, constraints).collect()}
    assert found == {("n", "even"): True, ("n", "big"): True, ("n", "far"): False, ("x", "half"): True, ("s", "ten"): False, ("b", "yes"): True, ("w", "all"): False}
