"""Queries over canonical bytes and over constraints as data, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import canonical
from .functions import programs as P
from .sources import views as V

# ---- canonical bytes: every order a trial of five parameters of five kinds ----------------------------------------------

#: hexadecimal digits of little-endian numbers, and of a text with its length before it
_LE = "array_to_string(list_reverse(regexp_extract_all(hex(CAST(CAST({} AS BIT) AS BLOB)), '..')), '')"
_LONG, _UINT, _DOUBLE = _LE.format("CAST({} AS BIGINT)"), _LE.format("CAST({} AS INTEGER)"), _LE.format("CAST({} AS DOUBLE)")
_TEXT = "hex(encode({0}))"
_FRAMED = _UINT.format("strlen({0})") + " || " + _TEXT
#: parameter, kind, its value's bytes in SQL
_PARAMETERS = [
    ("client", "integer", _LONG.format("o_custkey - 700")),
    ("late", "boolean", "CASE WHEN o_orderdate > TIMESTAMP '1996-01-01' THEN '01' ELSE '00' END"),
    ("price", "double", _DOUBLE.format("CASE WHEN o_orderkey % 50 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 50 = 1 THEN '-0.0'::DOUBLE ELSE o_totalprice / 3 END")),
    ("priority", "string", _FRAMED.format("o_orderpriority")),
    ("states", "selection", f"CASE WHEN o_orderstatus = 'F' THEN {_UINT.format(1)} || {_FRAMED.format(chr(39) + 'F' + chr(39))} ELSE {_UINT.format(2)} || CASE WHEN o_orderstatus < 'P' THEN {_FRAMED.format('o_orderstatus')} || {_FRAMED.format(chr(39) + 'P' + chr(39))} ELSE {_UINT.format(1)} || hex('P') || {_FRAMED.format(chr(39) + 'Q' + chr(39))} END END"),
]


def _fp(name: str, kind: str, body: str) -> str:
    return f"sha256(unhex('{canonical.TAGS[kind]:02X}' || {_TEXT.format(chr(39) + name + chr(39))} || '00' || {body}))"


def _values(s, d):
    """(trial_id, element, parameter, kind and a column a kind), five rows an order."""
    o = V.table(s, d, "orders")
    price = F.when(F.col("o_orderkey") % 50 == 0, float("nan")).when(F.col("o_orderkey") % 50 == 1, -0.0).otherwise(F.col("o_totalprice") / 3)
    states = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("F"), F.lit("F"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("Q"), F.lit("P"))).otherwise(F.array(F.lit("P"), F.col("o_orderstatus")))
    given = {
        "client": ("integer", {"int": F.col("o_custkey") - 700}), "late": ("boolean", {"bool": F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz")}), "price": ("double", {"num": price}),
        "priority": ("string", {"str": F.col("o_orderpriority")}), "states": ("selection", {"sel": states}),
    }
    kinds = {"int": "bigint", "num": "double", "bool": "boolean", "str": "string", "sel": "array<string>"}
    rows = [F.struct(F.lit("data" if p == "states" else "order").alias("element"), F.lit(p).alias("parameter"), F.lit(k).alias("kind"), *[v.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for p, (k, v) in given.items()]
    return o.select(F.col("o_orderkey").alias("trial_id"), F.inline(F.array(*rows)))


def _fingerprints(s, d):
    value = canonical.value_bytes(*map(F.col, ("kind", "parameter", "int", "num", "bool", "str", "sel")))
    return _values(s, d).select("trial_id", "element", "parameter", canonical.value_fingerprint(value).alias("fingerprint"))


@query(
    "value_fingerprints",
    " UNION ALL ".join(f"SELECT o_orderkey AS trial_id, '{'data' if n == 'states' else 'order'}' AS element, '{n}' AS parameter, {_fp(n, k, b)} AS fingerprint FROM orders" for n, k, b in _PARAMETERS),
    views=False,
)
def value_fingerprints(s, d):
    return _fingerprints(s, d)


def _param(name: str) -> str:
    n, k, b = next(p for p in _PARAMETERS if p[0] == name)
    return f"{_FRAMED.format(chr(39) + n + chr(39))} || upper({_fp(n, k, b)})"


@query(
    "trial_fingerprints",
    f"SELECT o_orderkey AS trial_id, sha256(unhex('60' || {_UINT.format(2)} || {_FRAMED.format(chr(39) + 'data' + chr(39))} || {_UINT.format(1)} || {_param('states')} || {_FRAMED.format(chr(39) + 'order' + chr(39))} || {_UINT.format(4)} || {' || '.join(map(_param, ('client', 'late', 'price', 'priority')))})) AS fingerprint FROM orders",
    views=False,
)
def trial_fingerprints(s, d):
    """Whole trials: elements and parameters in the order of their names."""
    return canonical.trial_bytes(_fingerprints(s, d)).select("trial_id", F.sha2("bytes", 256).alias("fingerprint"))


# ---- constraints as data: every brand of parts a parameter with bounds and constraints of its own ------------------------


def _brands(s, d):
    """parameters and constraints made from the parts: sizes are integers, but of every fifth brand texts."""
    p = V.table(s, d, "part").groupBy("p_brand").agg(F.min("p_size").cast("bigint").alias("low"), F.max("p_size").cast("bigint").alias("high"), F.count(F.lit(1)).alias("n"))
    p = p.withColumn("number", F.substring("p_brand", 7, 9).cast("int")).withColumn("texts", F.col("number") % 5 == 0)
    empty = {f.split(":", 1)[0]: f.split(":", 1)[1] for f in P.DOMAIN[7:-1].split(",")}
    given = {"int_low": F.col("low") + 2, "int_high": F.col("high") - 3, "pattern": F.when(F.col("texts"), "[05]$")}
    domain = F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in empty.items()])
    parameters = p.select(F.col("p_brand").alias("parameter"), F.when(F.col("texts"), "string").otherwise("integer").alias("kind"), domain.alias("domain"))
    middle, three = F.col("low") + F.col("n") % 20, F.lit(3)
    size = F.array(P.step("range", [F.col("low") + 4, F.col("high") - 4]), P.step("multiple", [three]), P.step("not"), P.step("and", n=2), P.step("in_set", [F.col("low"), middle]), P.step("or", n=2))
    size = F.transform(size, lambda x: x.withField("n", F.when(x["op"] == "not", 1).otherwise(x["n"])))
    least = F.array(P.step("min", [middle]))
    text = F.array(P.step("in_set", texts=[F.col("low").cast("string"), middle.cast("string")]), P.step("length_range", [F.lit(2), F.lit(2)]), P.step("or", n=2))
    size = p.where("not texts").select(F.col("p_brand").alias("parameter"), F.lit("size").alias("constraint"), F.lit("integer").alias("kind"), size.alias("program"))
    least = p.where("number % 2 = 0").select(F.col("p_brand").alias("parameter"), F.lit("least").alias("constraint"), F.lit("integer").alias("kind"), least.alias("program"))
    text = p.where("texts").select(F.col("p_brand").alias("parameter"), F.lit("text").alias("constraint"), F.lit("string").alias("kind"), text.alias("program"))
    return parameters, size.unionByName(least).unionByName(text)


_BRANDS = "WITH b AS (SELECT p_brand AS parameter, CAST(min(p_size) AS BIGINT) AS low, CAST(max(p_size) AS BIGINT) AS high, min(p_size) + count(*) % 20 AS middle, CAST(substr(p_brand, 7) AS INTEGER) AS number FROM part GROUP BY 1) "


@query(
    "validate_programs",
    _BRANDS + ", v AS (SELECT p_partkey, p_brand AS parameter, p_size AS x, CASE WHEN p_partkey % 11 = 0 THEN 'double' WHEN number % 5 = 0 THEN 'string' ELSE 'integer' END AS kind, b.* EXCLUDE parameter FROM part JOIN b ON b.parameter = p_brand)"
    " SELECT p_partkey, parameter, CASE WHEN kind = 'double' THEN ['kind mismatch'] WHEN kind = 'string' THEN list_filter([CASE WHEN NOT regexp_matches(x::VARCHAR, '[05]$') THEN 'not in domain' END, CASE WHEN number % 2 = 0 THEN 'constraint least' END, CASE WHEN NOT (x IN (low, middle) OR strlen(x::VARCHAR) = 2) THEN 'constraint text' END], lambda m: m IS NOT NULL)"
    " ELSE list_filter([CASE WHEN NOT x BETWEEN low + 2 AND high - 3 THEN 'not in domain' END, CASE WHEN number % 2 = 0 AND NOT x >= middle THEN 'constraint least' END, CASE WHEN NOT ((x BETWEEN low + 4 AND high - 4 AND NOT x % 3 = 0) OR x IN (low, middle)) THEN 'constraint size' END], lambda m: m IS NOT NULL) END AS violations FROM v",
    views=False,
)
def validate_programs(s, d):
    """All violations of every part's size by its brand's domain and constraints."""
    parameters, constraints = _brands(s, d)
    part = V.table(s, d, "part")
    texts = F.substring("p_brand", 7, 9).cast("int") % 5 == 0
    kind = F.when(F.col("p_partkey") % 11 == 0, "double").when(texts, "string").otherwise("integer")
    value = F.struct(F.when(~texts, F.col("p_size").cast("bigint")).alias("int"), F.lit(1.0).alias("num"), F.lit(None).cast("boolean").alias("bool"), F.when(texts, F.col("p_size").cast("string")).alias("str"), F.lit(None).cast("array<string>").alias("sel"))
    values = part.select("p_partkey", F.col("p_brand").alias("parameter"), kind.alias("kind"), value.alias("value"))
    return P.validate(values, parameters, constraints).select("p_partkey", "parameter", "violations")


@query(
    "satisfiable_programs",
    _BRANDS + "SELECT parameter, 'least' AS constraint, number % 5 <> 0 AND middle <= high - 3 AS satisfiable FROM b WHERE number % 2 = 0 UNION ALL SELECT parameter, 'text', false FROM b WHERE number % 5 = 0",
    views=False,
)
def satisfiable_programs(s, d):
    """Whether a brand's bounds reach its constraint: probes of integers, and of texts by the empty one.

    (The constraint of sizes is left out: it is met by samples, which have no SQL.)"""
    parameters, constraints = _brands(s, d)
    return P.satisfiable(parameters, constraints.where("constraint <> 'size'"))
