"""Every query of the engine's own operators, with the SQL that states its result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .functions import constraints as C
from .functions import domains as D
from .functions.expressions import Call, If, Ref, compile_expr, derive, lift
from .operators import aggregates as A
from .operators import graph, retention, scheduling, wiring
from .operators.filters import apply_filter, where
from .plans import grid, lifecycle
from .sources import views as V
from .streaming import journal as J

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = (V.SQL if views else "") + sql
        return f

    return keep


def flagship(spark, sf_dir: str):
    return _QUERIES["agg_percentile"](spark, sf_dir)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


# ---- filters -------------------------------------------------------------------------------------------------------

T0, T1 = dt.datetime(1995, 1, 1), dt.datetime(1997, 1, 1)
KEEP = ["trial_id", "status", "attempt", "code"]
LINE = ("line", "quantity")
QUANTITY = "(SELECT trial_id FROM wide WHERE {})"
FILTERS = {
    "filter_any": (where("any"), "true"),
    "filter_trial_id": (where("trial_id", 7), "trial_id = 7"),
    "filter_execution_id": (where("execution_id", 11), "execution_id = 11"),
    "filter_status": (where("status", "completed"), "status = 'completed'"),
    "filter_status_in": (where("status_in", ("failed", "skipped")), "status IN ('failed', 'skipped')"),
    "filter_status_in_empty": (where("status_in", ()), "false"),
    "filter_started_window": (where("started_after", T0) & where("started_before", T1), "started_at > TIMESTAMP '1995-01-01' AND started_at < TIMESTAMP '1997-01-01'"),
    "filter_attempt_cmp": (where("attempt", "ge", 2) & where("attempt", "ne", 3), "attempt >= 2 AND attempt <> 3"),
    "filter_metric_cmp": (where("metric", *LINE, "gt", 150.0), f"trial_id IN {QUANTITY.format('quantity > 150')}"),
    "filter_metric_eq": (where("metric", *LINE, "eq", 100.0), f"trial_id IN {QUANTITY.format('abs(quantity - 100) < 2.220446049250313e-16')}"),
    "filter_metric_not": (~where("metric", *LINE, "gt", 50.0), f"trial_id NOT IN {QUANTITY.format('quantity > 50')}"),
    "filter_assignment": (where("assignment", "order", "priority", "1-URGENT"), "trial_id IN (SELECT trial_id FROM assignments WHERE value = '1-URGENT')"),
    "filter_code_exact": (where("code", "0x123"), "code = '0x123'"),
    "filter_code_prefix": (where("code_prefix", "0x2a"), "starts_with(code, '0x2a')"),
    "filter_bool_tree": (
        (where("status", "failed") | where("metric", *LINE, "lt", 60.0)) & ~(where("attempt", "eq", 1) & where("assignment", "order", "priority", "5-LOW")),
        f"(status = 'failed' OR trial_id IN {QUANTITY.format('quantity < 60')}) AND NOT (attempt = 1 AND trial_id IN (SELECT trial_id FROM assignments WHERE value = '5-LOW'))",
    ),
    "filter_and_empty": (where("and"), "true"),
    "filter_or_empty": (where("or"), "false"),
}
for _name, (_f, _sql) in FILTERS.items():
    query(_name, f"SELECT trial_id, status, attempt, code FROM results WHERE {_sql}")(
        lambda s, d, f=_f: apply_filter(V.trial_results(s, d), f, V.trial_metrics(s, d), V.assignments(s, d)).select(*KEEP)
    )


@query("filter_labels", "SELECT trial_id FROM results WHERE status = 'completed' AND NOT coalesce(CASE WHEN attempt > 1 THEN attempt END = 2, false)")
def filter_labels(s, d):
    r = V.trial_results(s, d).withColumn("labels", F.create_map(F.lit("state"), F.col("status"))).withColumn("tags", F.when(F.col("attempt") > 1, F.create_map(F.lit("try"), F.col("attempt").cast("string"))))
    return apply_filter(r, where("label", "state", "completed") & ~where("tag", "try", "2")).select("trial_id")


@query("filter_count", "SELECT count(*) AS value FROM results WHERE status = 'failed' OR attempt = 2")
def filter_count(s, d):
    return A.aggregate(apply_filter(V.trial_results(s, d), where("status", "failed") | where("attempt", "eq", 2)), A.Aggregation("count"))


# ---- aggregates ----------------------------------------------------------------------------------------------------

JOINED = "results JOIN wide USING (trial_id)"


def _agg(name, a, sql):
    query(name, sql)(lambda s, d: A.aggregate(V.trial_results(s, d), a, V.trial_metrics(s, d), V.assignments(s, d)))


_agg("agg_count", A.Aggregation("count"), "SELECT count(*) AS value FROM results")
for _op in ("min", "max", "sum", "avg"):
    _agg(f"agg_{_op}", A.Aggregation(_op, LINE), f"SELECT CAST({_op}(quantity) AS DOUBLE) AS value FROM {JOINED}")
_agg("agg_group_status", A.Aggregation("avg", LINE, by=("status",)), f"SELECT status AS key0, avg(quantity) AS value FROM {JOINED} GROUP BY 1")
_agg("agg_group_assignment", A.Aggregation("max", ("line", "price"), by=(("assignment", "order", "priority"),)), f"SELECT value AS key0, max(price) AS value FROM {JOINED} JOIN assignments USING (trial_id) GROUP BY 1")
_agg("agg_group_digit", A.Aggregation("count", by=(("digit", 1),)), "SELECT substr(code, 4, 1) AS key0, count(*) AS value FROM results GROUP BY 1")
_agg("agg_group_nested", A.Aggregation("sum", LINE, by=("status", ("digit", 2))), f"SELECT status AS key0, substr(code, 5, 1) AS key1, sum(quantity) AS value FROM {JOINED} GROUP BY 1, 2")
_PERCENTILE = "SELECT {k}, v AS value FROM (SELECT {k}, {m} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {m}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {j}) WHERE i = floor({p} * (n - 1))"
_agg("agg_percentile_status", A.Aggregation("percentile", LINE, 0.9, by=("status",)), _PERCENTILE.format(k="key0", m="quantity", p="0.9::DOUBLE", j=f"(SELECT status AS key0, quantity FROM {JOINED})"))


@query("agg_percentile", _PERCENTILE.format(k="key0", m="price", p="0.5::DOUBLE", j=f"(SELECT value AS key0, price FROM {JOINED} JOIN assignments USING (trial_id) WHERE status = 'completed')"))
def agg_percentile(s, d):
    done = apply_filter(V.trial_results(s, d), where("status", "completed"))
    return A.aggregate(done, A.Aggregation("percentile", ("line", "price"), 0.5, by=(("assignment", "order", "priority"),)), V.trial_metrics(s, d), V.assignments(s, d))


@query("agg_empty", "SELECT CAST(NULL AS DOUBLE) AS value")
def agg_empty(s, d):
    return A.aggregate(apply_filter(V.trial_results(s, d), where("or")), A.Aggregation("max", LINE), V.trial_metrics(s, d))


@query("exec_summary", "SELECT execution_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total FROM results GROUP BY 1")
def exec_summary(s, d):
    return A.summary(V.trial_results(s, d), "execution_id")


# ---- expressions and derived parameters ----------------------------------------------------------------------------

SCHEMA = {"k": "integer", "q": "double", "t": "string", "b": "boolean"}


def _lines(s, d):
    return V.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", (F.col("l_orderkey") * 1000003).alias("k"), (F.col("l_quantity") - 25).alias("q"), F.col("l_returnflag").alias("t"), (F.col("l_discount") > 0.05).alias("b"))


_ID = ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"]
_LINES = "WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_orderkey * 1000003 AS k, l_quantity - 25 AS q, l_returnflag AS t, l_discount > 0.05 AS b FROM lineitem) SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, {} FROM x"
K, Q, TX, B = Ref("k"), Ref("q"), Ref("t"), Ref("b")
_WRAP = "CAST((({}) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT)"
EXPRESSIONS = {
    "expr_arith": ({"a": K * 1000 + 7, "c": Q * 2.0 - 1.5}, "k * 1000 + 7 AS a, q * 2.0::DOUBLE - 1.5::DOUBLE AS c"),
    "expr_wrap": ({"a": K + 9223372036854775807}, _WRAP.format("k::HUGEINT + 9223372036854775807") + " AS a"),
    "expr_div_mod": ({"a": (-K) / 7, "c": (-K) % 7, "e": lift(1.0) / Q}, "-k // 7 AS a, -k % 7 AS c, 1.0::DOUBLE / q AS e"),
    "expr_round_half_even": ({"a": Call("round", (Q / 2.0,)), "c": Call("ceil", (Q / 4.0,)), "e": Call("floor", (Q / 4.0,))}, "CAST(round_even(q / 2.0::DOUBLE, 0) AS BIGINT) AS a, CAST(ceil(q / 4.0::DOUBLE) AS BIGINT) AS c, CAST(floor(q / 4.0::DOUBLE) AS BIGINT) AS e"),
    "expr_minmax": ({"a": Call("min", (K, lift(500))), "c": Call("max", (lift(0.0) / Q, lift(-1.0)))}, "least(k, 500) AS a, CASE WHEN q = 0 THEN -1.0::DOUBLE ELSE greatest(0.0::DOUBLE / q, -1.0::DOUBLE) END AS c"),
    "expr_abs_pow": ({"a": Call("abs", (-K,)), "c": Call("pow", (Q, lift(2.0)))}, "abs(-k) AS a, pow(q, 2.0::DOUBLE) AS c"),
    "expr_len_bytes": ({"a": Call("len", (TX,))}, "CAST(strlen(t) AS BIGINT) AS a"),
    "expr_if": ({"a": If(B & (Q > 0.0), K, lift(-1)), "c": ~B | K.eq(3)}, "CASE WHEN b AND q > 0 THEN k ELSE -1 END AS a, NOT b OR k = 3 AS c"),
    "expr_nan": ({"a": (Q / Q).eq(Q / Q), "c": (Q / Q).ne(lift(1.0))}, "q <> 0 AS a, q = 0 AS c"),
}
for _name, (_e, _sql) in EXPRESSIONS.items():
    query(_name, _LINES.format(_sql), views=False)(lambda s, d, e=_e: _lines(s, d).select(*_ID, *[compile_expr(x, SCHEMA).alias(n) for n, x in e.items()]))


@query("derived_param", _LINES.format("CASE WHEN b THEN q * 3.0::DOUBLE ELSE q END AS boost"), views=False)
def derived_param(s, d):
    return derive(_lines(s, d), "boost", "double", If(B, Q * 3.0, Q), SCHEMA).select(*_ID, "boost")


# ---- constraints and domains ---------------------------------------------------------------------------------------

_PART = "SELECT p_partkey, {} AS ok FROM part"
_I = lambda op, *a: C.leaf("integer", op, *a)
CONSTRAINTS = {
    "constraint_int": ((_I("range", 5, 40) & ~_I("in_set", 7, 8)) | _I("multiple", 15), "p_size", "(p_size BETWEEN 5 AND 40 AND p_size NOT IN (7, 8)) OR p_size % 15 = 0"),
    "constraint_int_set": (_I("not_in_set", 1, 2, 3) & _I("min", 2) & _I("max", 30), "p_size", "p_size NOT IN (1, 2, 3) AND p_size >= 2 AND p_size <= 30"),
    "constraint_double": (C.leaf("double", "range", 900.0, 1500.0) & ~C.leaf("double", "min", 1400.0), "p_retailprice", "p_retailprice BETWEEN 900 AND 1500 AND NOT p_retailprice >= 1400"),
    "constraint_string": (C.leaf("string", "regex", "[aeiou]{2}") | C.leaf("string", "length_range", 1, 9), "p_name", "regexp_matches(p_name, '[aeiou]{2}') OR strlen(p_name) BETWEEN 1 AND 9"),
}
for _name, (_c, _col, _sql) in CONSTRAINTS.items():
    query(_name, _PART.format(_sql), views=False)(lambda s, d, c=_c, v=_col: V.table(s, d, "part").select("p_partkey", C.compile_constraint(C.canonical(c), F.col(v)).alias("ok")))


@query("constraint_bool_typed", "SELECT p_partkey, p_size > 20 AS eq_true, false AS other_kind FROM part", views=False)
def constraint_bool_typed(s, d):
    c = C.leaf("boolean", "eq_to", True)
    big = F.col("p_size") > 20
    return V.table(s, d, "part").select("p_partkey", C.test_typed(c, F.lit("boolean"), big).alias("eq_true"), C.test_typed(c, F.lit("integer"), big).alias("other_kind"))


@query("constraint_selection", "WITH x AS (SELECT c_custkey, list_value(c_mktsegment, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END) AS sel FROM customer) SELECT c_custkey, list_contains(sel, 'rich') AND list_contains(sel, 'BUILDING') AS every, list_has_any(sel, ['rich', 'BUILDING']) AS some, NOT list_has_any(sel, ['rich', 'BUILDING']) AS none, len(sel) >= 2 AS two FROM x", views=False)
def constraint_selection(s, d):
    x = V.table(s, d, "customer").select("c_custkey", F.array("c_mktsegment", F.when(F.col("c_acctbal") > 5000, "rich").otherwise("plain")).alias("sel"))
    test = lambda op, *a: C.compile_constraint(C.leaf("selection", op, *a), F.col("sel"))
    return x.select("c_custkey", test("require_all", "rich", "BUILDING").alias("every"), test("require_any", "rich", "BUILDING").alias("some"), test("forbid_all", "rich", "BUILDING").alias("none"), test("min_size", 2).alias("two"))


@query("validate_violations", "SELECT p_partkey, list_filter([CASE WHEN NOT p_size <= 30 THEN 'size' END, CASE WHEN NOT p_retailprice >= 1200 THEN 'price' END], lambda x: x IS NOT NULL) AS violations FROM part", views=False)
def validate_violations(s, d):
    checks = {"size": C.compile_constraint(_I("max", 30), F.col("p_size")), "price": C.compile_constraint(C.leaf("double", "min", 1200.0), F.col("p_retailprice"))}
    return V.table(s, d, "part").select("p_partkey", C.violations(checks).alias("violations"))


@query("result_validation", "SELECT trial_id, attempt >= 1 AS ok FROM results")
def result_validation(s, d):
    return V.trial_results(s, d).select("trial_id", (F.size(C.violations({"attempt": F.col("attempt") >= 1, "started": F.col("started_at").isNotNull()})) == 0).alias("ok"))


@query("domain_contains", "SELECT p_partkey, p_size IN (1, 5, 9, 14) AS listed, p_size BETWEEN 3 AND 20 AS ranged, regexp_matches(p_type, 'A') AS named FROM part", views=False)
def domain_contains(s, d):
    return V.table(s, d, "part").select("p_partkey", D.Domain("integer", values=(1, 5, 9, 14)).contains(F.col("p_size")).alias("listed"), D.Domain("integer", 3, 20).contains(F.col("p_size")).alias("ranged"), D.Domain("string", pattern="A").contains(F.col("p_type")).alias("named"))


@query("domain_enumerate", "SELECT CAST(v AS BIGINT) AS value, CAST(v - low AS BIGINT) AS i FROM (SELECT unnest(range(min(o_orderkey), max(o_orderkey) + 1)) AS v, min(o_orderkey) AS low FROM orders)", views=False)
def domain_enumerate(s, d):
    """All integers between the first and the last order's number."""
    low, high = V.table(s, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return D.Domain("integer", low, high).enumerate(s)


@query("domain_boundaries", "SELECT min(p_size) AS low, max(p_size) AS high, CAST(max(p_size) - min(p_size) + 1 AS BIGINT) AS cardinality FROM part", views=False)
def domain_boundaries(s, d):
    low, high = V.table(s, d, "part").agg(F.min("p_size"), F.max("p_size")).first()
    dom = D.Domain("integer", low, high)
    b = dom.boundaries()
    return s.range(1).select(F.lit(b[0]).alias("low"), F.lit(b[-1]).alias("high"), F.lit(dom.cardinality()).cast("bigint").alias("cardinality"))


# ---- grids ---------------------------------------------------------------------------------------------------------

_SIZES = "(SELECT count(DISTINCT p_type) FROM part) AS s0, (SELECT count(DISTINCT p_brand) FROM part) AS s1, (SELECT count(DISTINCT s_name) FROM supplier) AS s2"
_GRID = f"WITH n AS (SELECT {_SIZES}), g AS (SELECT t.i AS trial, t.i // (s1 * s2) % s0 AS o0, t.i // s2 % s1 AS o1, t.i % s2 AS o2, n.* FROM (SELECT unnest(range(s0 * s1 * s2)) AS i FROM n) t, n) "
_WIDE = "CASE WHEN greatest({0}) <= 16 THEN 1 ELSE greatest(2, length(format('{{:x}}', greatest({0}) - 1))) END"
_DIGIT = "lpad(format('{{:x}}', {0}), {1}::INT, '0')"


def _axes(s, d):
    """Axes of the distinct part types, brands and supplier names."""
    part, k = V.table(s, d, "part"), V.table(s, d, "supplier")
    return [grid.TableAxis.of("part", "type", F.col("p_type"), part), grid.TableAxis.of("part", "brand", F.col("p_brand"), part), grid.TableAxis.of("supplier", "name", F.col("s_name"), k)]


def _total(s, d):
    sizes = [V.table(s, d, t).select(c).distinct().count() for t, c in (("part", "p_type"), ("part", "p_brand"), ("supplier", "s_name"))]
    return sizes[0] * sizes[1] * sizes[2]


@query("grid_offsets", _GRID + "SELECT trial, o0, o1, o2 FROM g", views=False)
def grid_offsets(s, d):
    return grid.enumerate_tables(s, _axes(s, d)).select("trial", "o0", "o1", "o2")


@query("grid_index_roundtrip", _GRID + "SELECT trial, trial AS again FROM g", views=False)
def grid_index_roundtrip(s, d):
    axes = _axes(s, d)
    return grid.enumerate_tables(s, axes).select("trial", grid.index([F.col("o0"), F.col("o1"), F.col("o2")], [a.size for a in axes]).alias("again"))


@query("grid_code8", _GRID + ", w AS (SELECT *, " + _WIDE.format("s0, s1, s2") + " AS w FROM g) SELECT trial, '0x' || " + " || ".join(_DIGIT.format(f"o{i}", "w") for i in range(3)) + " AS code FROM w", views=False)
def grid_code8(s, d):
    return grid.enumerate_tables(s, _axes(s, d)).select("trial", "code")


@query("grid_code4", "WITH n AS (SELECT (SELECT count(DISTINCT p_type) FROM part) AS s0, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS s1) SELECT i AS trial, '0x' || format('{:x}', i // s1) || format('{:x}', i % s1) AS code FROM (SELECT unnest(range(s0 * s1)) AS i, s1 FROM n)", views=False)
def grid_code4(s, d):
    """Two short axes: one digit each."""
    axes = [grid.TableAxis.of("part", "type", F.col("p_type"), V.table(s, d, "part")), grid.TableAxis.of("order", "priority", F.col("o_orderpriority"), V.table(s, d, "orders"))]
    return grid.enumerate_tables(s, axes).select("trial", "code")


@query("grid_assignments", _GRID + ", v AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS place FROM (SELECT DISTINCT s_name FROM supplier)) SELECT trial, 'supplier' AS element, 'name' AS parameter, s_name AS value FROM g JOIN v ON v.place = o2", views=False)
def grid_assignments(s, d):
    axes = _axes(s, d)
    return grid.assignments(grid.enumerate_tables(s, axes), axes).where("parameter = 'name'")


@query("order_edge_first", _GRID + ", e AS (SELECT trial, (o0 IN (0, s0 - 1))::INT + (o1 IN (0, s1 - 1))::INT + (o2 IN (0, s2 - 1))::INT AS edges FROM g) SELECT trial, edges, row_number() OVER (ORDER BY edges DESC, trial) - 1 AS position FROM e", views=False)
def order_edge_first(s, d):
    axes = _axes(s, d)
    return grid.order(grid.enumerate_tables(s, axes), axes, "edge_first").select("trial", "edges", "position")


@query("order_shuffled", _GRID + "SELECT trial, row_number() OVER (ORDER BY md5('s:' || trial), trial) - 1 AS position FROM g", views=False)
def order_shuffled(s, d):
    axes = _axes(s, d)
    return grid.order(grid.enumerate_tables(s, axes), axes, "shuffled", "s").select("trial", "position")


@query("sample_linspace", _GRID + ", k AS (SELECT unnest(range(least(40, s0 * s1 * s2))) AS i, s0 * s1 * s2 AS total FROM n) SELECT DISTINCT i * (total - 1) // (least(40, total) - 1) AS trial FROM k", views=False)
def sample_linspace(s, d):
    return grid.sample(s, _total(s, d), "linspace", 40)


@query("sample_random", _GRID + "SELECT trial FROM g ORDER BY md5('r:' || trial), trial LIMIT 25", views=False)
def sample_random(s, d):
    return grid.sample(s, _total(s, d), "random", 25, "r")


#: suppliers as elements: each needs the one of half its number, in three ways by turns; lifelines carry no level
_LINKS = "'e' || s_suppkey AS src, 'e' || s_suppkey // 2 AS dst, CASE s_suppkey % 3 WHEN 0 THEN 'shared' WHEN 1 THEN 'linear' ELSE 'lifeline' END AS kind"
_HALVES = f"WITH RECURSIVE l AS (SELECT {_LINKS} FROM supplier WHERE s_suppkey // 2 IN (SELECT s_suppkey FROM supplier)), own AS (SELECT 'e' || s_suppkey AS element, s_suppkey, CAST(sum(s_nationkey % 3) OVER (ORDER BY -s_suppkey) AS BIGINT) AS own FROM supplier)"


def _elements(s, d):
    """Suppliers as elements, authored from the last to the first, and their links."""
    k = V.table(s, d, "supplier")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    e = k.select((-F.col("s_suppkey")).alias("pos"), name(F.col("s_suppkey")).alias("element"), (F.col("s_nationkey") % 3).cast("long").alias("axes"), (F.col("s_nationkey") % 4).alias("level"), (F.col("s_suppkey") % 2 == 0).alias("health"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "shared").when(F.col("s_suppkey") % 3 == 1, "linear").otherwise("lifeline")
    links = k.where("s_suppkey div 2 <> s_suppkey").select(name(F.col("s_suppkey")).alias("src"), name(F.expr("s_suppkey div 2")).alias("dst"), kind.alias("kind"))
    return e, links.join(e.select(F.col("element").alias("dst")), "dst", "left_semi").select("src", "dst", "kind")


@query(
    "binding_levels",
    _HALVES + ", up AS (SELECT src, dst FROM l WHERE kind <> 'lifeline' UNION SELECT u.src, l.dst FROM up u JOIN l ON l.src = u.dst AND l.kind <> 'lifeline') SELECT o.element, o.own, greatest(o.own, coalesce(max(p.own), o.own)) AS effective FROM own o LEFT JOIN up ON up.src = o.element LEFT JOIN own p ON p.element = up.dst GROUP BY 1, 2",
    views=False,
)
def binding_levels(s, d):
    e, links = _elements(s, d)
    return grid.binding_levels(e.select("pos", "element", "axes"), links)


@query(
    "config_resolution",
    "SELECT o_orderkey AS trial, 'order' AS element, p.parameter, CASE p.parameter WHEN 'priority' THEN o_orderpriority WHEN 'size' THEN 'bound' WHEN 'mode' THEN 'fallback' END AS value, CASE p.parameter WHEN 'priority' THEN 'axis' WHEN 'size' THEN 'binding' WHEN 'mode' THEN 'default' ELSE 'unresolved' END AS source FROM orders, (VALUES ('priority'), ('size'), ('mode'), ('none')) p(parameter)",
    views=False,
)
def config_resolution(s, d):
    a = V.assignments(s, d).withColumnRenamed("trial_id", "trial")
    need = a.select("trial", "element", F.explode(F.array(*[F.lit(x) for x in ("priority", "size", "mode", "none")])).alias("parameter"))
    table = lambda *rows: s.createDataFrame(list(rows), "element string, parameter string, value string")
    return grid.resolve(need, a, table(("order", "size", "bound"), ("order", "priority", "lost")), table(("order", "size", "lost")), table(("order", "mode", "fallback")))


# ---- pages, retention, upserts -------------------------------------------------------------------------------------


@query("page_first", "SELECT trial_id, status FROM results ORDER BY trial_id LIMIT 50")
def page_first(s, d):
    return A.page(V.trial_results(s, d).select("trial_id", "status"), "trial_id", None, 50)


@query("page_next", "SELECT trial_id, status FROM results WHERE trial_id > 120 ORDER BY trial_id LIMIT 50")
def page_next(s, d):
    return A.page(V.trial_results(s, d).select("trial_id", "status"), "trial_id", 120, 50)


@query("page_desc", "SELECT trial_id, started_at FROM results WHERE started_at < TIMESTAMP '1996-06-01' OR (started_at = TIMESTAMP '1996-06-01' AND trial_id < 500) ORDER BY started_at DESC, trial_id DESC LIMIT 40")
def page_desc(s, d):
    return A.page_desc(V.trial_results(s, d).select("trial_id", "started_at"), "started_at", "trial_id", (dt.datetime(1996, 6, 1), 500), 40)


def _artifacts(s, d):
    return V.table(s, d, "orders").select(F.col("o_custkey").alias("context"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").cast("bigint").alias("size"))


_ART = "WITH art AS (SELECT o_custkey AS context, o_orderkey AS id, o_orderdate AS created, CAST(trunc(o_totalprice) AS BIGINT) AS size FROM orders)"


@query("retain_age", _ART + " SELECT * FROM art WHERE created >= TIMESTAMP '1996-01-01'", views=False)
def retain_age(s, d):
    return retention.keep_young(_artifacts(s, d), "created", dt.datetime(1996, 1, 1))


@query("retain_newest", _ART + " SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY context ORDER BY created DESC, id DESC) <= 3", views=False)
def retain_newest(s, d):
    return retention.keep_newest(_artifacts(s, d), ["context"], "created", "id", 3)


_HELD = "sum(size) OVER (PARTITION BY context ORDER BY created DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {}"


@query("retain_size_cap", _ART + " SELECT * FROM art QUALIFY " + _HELD.format(600000), views=False)
def retain_size_cap(s, d):
    return retention.keep_size(_artifacts(s, d), ["context"], "created", "id", "size", 600000)


@query("retain_chain", _ART + ", y AS (SELECT * FROM art WHERE created >= TIMESTAMP '1994-01-01'), k AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY context ORDER BY created DESC, id DESC) <= 5) SELECT * FROM k QUALIFY " + _HELD.format(500000), views=False)
def retain_chain(s, d):
    return retention.retain(_artifacts(s, d), ["context"], "created", "id", "size", dt.datetime(1994, 1, 1), 5, 500000)


@query("upsert_latest", "SELECT execution_id, step_id, sequence, kind FROM journal QUALIFY row_number() OVER (PARTITION BY execution_id, step_id ORDER BY sequence DESC) = 1")
def upsert_latest(s, d):
    return retention.latest(V.journal(s, d), ["execution_id", "step_id"], "sequence").select("execution_id", "step_id", "sequence", "kind")


@query("metric_explode", "SELECT trial_id, 'line' AS element, parameter, value_num FROM (UNPIVOT wide ON quantity, price, discount INTO NAME parameter VALUE value_num)")
def metric_explode(s, d):
    return V.trial_metrics(s, d).select("trial_id", "element", "parameter", "value_num")


@query("navigate_plan_executions", "SELECT c_mktsegment AS plan, count(*) AS trials, max(started_at) AS latest FROM results JOIN customer ON c_custkey = execution_id GROUP BY 1")
def navigate_plan_executions(s, d):
    plans = V.table(s, d, "customer").select(F.col("c_custkey").alias("execution_id"), F.col("c_mktsegment").alias("plan"))
    return V.trial_results(s, d).join(plans, "execution_id").groupBy("plan").agg(F.count(F.lit(1)).alias("trials"), F.max("started_at").alias("latest"))


# ---- journal -------------------------------------------------------------------------------------------------------


@query("journal_replay", "SELECT execution_id, sequence, kind FROM journal WHERE sequence > 3")
def journal_replay(s, d):
    return J.replay(V.journal(s, d), 3).select("execution_id", "sequence", "kind")


@query("journal_truncate", "SELECT execution_id, sequence, kind FROM journal WHERE sequence >= 5")
def journal_truncate(s, d):
    return J.truncate(V.journal(s, d), 5).select("execution_id", "sequence", "kind")


@query("journal_append", "SELECT execution_id, sequence, kind FROM journal")
def journal_append(s, d):
    j = V.journal(s, d).select("execution_id", "sequence", "kind")
    return J.append(j.where("sequence <= 6"), j.where("sequence >= 4"))


@query("journal_latest", "SELECT execution_id, sequence, kind FROM journal QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY sequence DESC) = 1")
def journal_latest(s, d):
    return J.last_event(V.journal(s, d)).select("execution_id", "sequence", "kind")


@query("journal_latest_sequence", "SELECT c_custkey AS execution_id, coalesce(max(sequence), 0) AS sequence FROM customer LEFT JOIN journal ON c_custkey = execution_id GROUP BY 1")
def journal_latest_sequence(s, d):
    return J.latest_sequence(V.journal(s, d), V.table(s, d, "customer").select(F.col("c_custkey").alias("execution_id")))


@query(
    "journal_recovery",
    "SELECT execution_id, step_id, bool_or(kind = 'step_completed') AS completed, bool_or(kind = 'step_failed') AS failed, bool_or(kind = 'step_skipped') AS skipped, coalesce(max(sequence) FILTER (kind = 'step_started') > coalesce(max(sequence) FILTER (kind IN ('step_completed', 'step_failed', 'step_skipped')), -1), false) AS in_flight FROM journal GROUP BY 1, 2",
)
def journal_recovery(s, d):
    return J.recovery(V.journal(s, d))


@query("step_statistics", "SELECT step_id, count(*) FILTER (kind = 'step_started') AS attempts, count(*) FILTER (kind = 'step_completed') AS successes, count(*) FILTER (kind = 'step_failed') AS failures, count(*) FILTER (kind = 'step_skipped') AS skips FROM journal GROUP BY 1")
def step_statistics(s, d):
    return J.step_statistics(V.journal(s, d))


def _sessions(s, d):
    kind = F.when(F.col("kind") == "execution_started", "trial_start").when(F.col("kind") == "step_skipped", "trial_end").otherwise(F.col("kind"))
    return V.journal(s, d).select("execution_id", F.col("step_id").alias("trial"), "sequence", kind.alias("kind"), "ts", F.when(F.col("kind") == "step_completed", F.lit("value")).alias("metric"), "value")


@query(
    "trial_synthesis",
    "SELECT execution_id, step_id AS trial, CASE WHEN bool_or(kind = 'step_failed') THEN 'failed' ELSE 'completed' END AS status, min(ts) FILTER (kind = 'execution_started') AS started_at, max(ts) FILTER (kind = 'step_skipped') AS completed_at, arg_max(value, sequence) FILTER (kind = 'step_completed') AS last_value FROM journal GROUP BY 1, 2 HAVING bool_or(kind = 'step_skipped')",
)
def trial_synthesis(s, d):
    return J.synthesize(_sessions(s, d)).select("execution_id", "trial", "status", "started_at", "completed_at", F.col("metrics")["value"].alias("last_value"))


# ---- graphs, plans, wiring, scheduling -----------------------------------------------------------------------------


@query("dag_closure", "SELECT src, dst FROM reach")
def dag_closure(s, d):
    return graph.closure(V.dag(s, d)[1])


@query("dag_dependencies", "SELECT dst AS node, src AS dependency FROM reach WHERE dst IN ('s1', 's3', 's6')")
def dag_dependencies(s, d):
    return graph.dependencies(V.dag(s, d)[1], s.createDataFrame([("s1",), ("s3",), ("s6",)], "node string"))


@query("dag_waves", "SELECT node, depth FROM depth")
def dag_waves(s, d):
    return graph.depths(*V.dag(s, d))


@query("dag_reduction", "SELECT src, dst FROM edge WHERE NOT (src LIKE 'r%' AND dst LIKE 's%')")
def dag_reduction(s, d):
    return graph.reduction(V.dag(s, d)[1])


@query(
    "dag_stats",
    "SELECT CAST(3 AS INTEGER) AS depth, (SELECT max(c) FROM (SELECT count(*) AS c FROM depth GROUP BY depth)) AS max_parallelism, (SELECT avg(c) FROM (SELECT count(*) AS c FROM depth GROUP BY depth)) AS average_parallelism, (SELECT count(*) FROM node) AS nodes, (SELECT max(c) FROM (SELECT count(*) AS c FROM edge GROUP BY dst)) AS max_fan_in, (SELECT max(c) FROM (SELECT count(*) AS c FROM edge GROUP BY src)) AS max_fan_out, (SELECT count(*) FROM edge) AS edges",
)
def dag_stats(s, d):
    return graph.statistics(*V.dag(s, d)).withColumn("nodes", F.col("nodes").cast("bigint"))


_STATE = "CASE WHEN node LIKE 'r%' THEN 'completed' WHEN node LIKE 'n%' AND CAST(substr(node, 2) AS INT) % 3 = 0 THEN 'skipped' WHEN node LIKE 'n%' AND CAST(substr(node, 2) AS INT) % 3 = 1 THEN 'failed' ELSE 'pending' END"


def _states(s, d):
    n, e = V.dag(s, d)
    k = F.substring("node", 2, 9).cast("int") % 3
    nation = F.col("node").startswith("n")
    return n.withColumn("state", F.when(F.col("node").startswith("r"), "completed").when(nation & (k == 0), "skipped").when(nation & (k == 1), "failed").otherwise("pending")), e


@query("dag_ready_set", f", st AS (SELECT node, {_STATE} AS state FROM node) SELECT node FROM st WHERE state = 'pending' AND NOT EXISTS (SELECT 1 FROM edge JOIN st s2 ON s2.node = edge.src WHERE edge.dst = st.node AND s2.state NOT IN ('completed', 'skipped'))")
def dag_ready_set(s, d):
    return graph.ready(*_states(s, d))


@query("dag_cascade", f", st AS (SELECT node, {_STATE} AS state FROM node) SELECT DISTINCT s2.node FROM reach JOIN st ON st.node = reach.src AND st.state = 'failed' JOIN st s2 ON s2.node = reach.dst WHERE s2.state = 'pending'")
def dag_cascade(s, d):
    return graph.cascade(*_states(s, d))


@query("dag_problems", "SELECT 'dangling' AS problem, node FROM node WHERE node LIKE 'r%'")
def dag_problems(s, d):
    n, e = V.dag(s, d)
    return graph.problems(n.where("node not like 'r%'"), e)


@query(
    "plan_lifecycle",
    "WITH n AS (SELECT (SELECT count(DISTINCT o_orderpriority) FROM orders) AS s0, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS s1), e AS (SELECT 'e' || s_suppkey AS element, CASE least(s_nationkey % 4, 2) WHEN 0 THEN s0 * s1 WHEN 1 THEN s1 ELSE 1 END AS size, s0 * s1 AS total FROM supplier, n), g AS (SELECT *, unnest(range((total + size - 1) // size)) AS grp FROM e)"
    " SELECT kind || ':' || element || ':' || grp AS node, kind, element, CASE kind WHEN 'deploy' THEN grp * size ELSE least((grp + 1) * size, total) - 1 END AS trial FROM g, (VALUES ('deploy'), ('teardown')) k(kind)",
    views=False,
)
def plan_lifecycle(s, d):
    """Deploys and teardowns of suppliers over the trials of two axes of orders; levels say who shares an instance."""
    o = V.table(s, d, "orders")
    axes = [grid.TableAxis.of("order", "priority", F.col("o_orderpriority"), o), grid.TableAxis.of("order", "status", F.col("o_orderstatus"), o)]
    e, _ = _elements(s, d)
    return lifecycle.steps(grid.enumerate_tables(s, axes).select("trial"), e, [a.size for a in axes]).select("node", "kind", "element", "trial")


@query("trial_elements", "SELECT 'e' || s_suppkey AS element FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey // 2 FROM supplier)", views=False)
def trial_elements(s, d):
    """Suppliers that no other one needs."""
    return lifecycle.trial_elements(*_elements(s, d))


_PLUGS = "WITH p AS (SELECT c_custkey AS plug, ['seg:' || c_mktsegment, 'r:' || (c_nationkey % 3)] AS facets FROM customer), k AS (SELECT s_suppkey AS socket, ['r:' || (s_nationkey % 3), 'seg:BUILDING', CASE WHEN s_suppkey % 2 = 0 THEN 'seg:MACHINERY' ELSE 'seg:NONE' END] AS facets FROM supplier), f AS (SELECT plug, socket FROM p, k WHERE list_has_all(k.facets, p.facets)) "


def _ports(s, d):
    c, k = V.table(s, d, "customer"), V.table(s, d, "supplier")
    plugs = c.select(F.col("c_custkey").alias("plug"), F.array(F.concat(F.lit("seg:"), "c_mktsegment"), F.concat(F.lit("r:"), F.col("c_nationkey") % 3)).alias("facets"))
    sockets = k.select(F.col("s_suppkey").alias("socket"), F.array(F.concat(F.lit("r:"), F.col("s_nationkey") % 3), F.lit("seg:BUILDING"), F.when(F.col("s_suppkey") % 2 == 0, "seg:MACHINERY").otherwise("seg:NONE")).alias("facets"))
    return plugs, sockets


@query("wiring_match", _PLUGS + "SELECT plug, socket FROM f", views=False)
def wiring_match(s, d):
    return wiring.fits(*_ports(s, d))


@query("wiring_classify", _PLUGS + ", n AS (SELECT p.plug, count(f.socket) AS sockets FROM p LEFT JOIN f USING (plug) GROUP BY 1) SELECT plug, sockets, CASE sockets WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS match FROM n", views=False)
def wiring_classify(s, d):
    return wiring.classify(*_ports(s, d))


@query("wiring_match_all", _PLUGS + "SELECT plug, socket FROM f", views=False)
def wiring_match_all(s, d):
    return wiring.fits(*_ports(s, d))


@query("wiring_classify_all", _PLUGS + ", n AS (SELECT p.plug, count(f.socket) AS sockets FROM p LEFT JOIN f USING (plug) GROUP BY 1) SELECT plug, sockets, CASE sockets WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS match FROM n", views=False)
def wiring_classify_all(s, d):
    return wiring.classify(*_ports(s, d))


def _queue(s, d):
    return V.table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("queue"), F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").alias("cpu"), F.max("l_tax").alias("memory"), F.max("l_partkey").alias("priority")).withColumn("step", F.concat_ws("-", F.lpad(F.col("trial").cast("string"), 9, "0"), F.col("line").cast("string"))).drop("line")


_QUEUE = "WITH q AS (SELECT l_orderkey % 50 AS queue, l_orderkey AS trial, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || l_linenumber AS step, max(l_quantity) AS cpu, max(l_tax) AS memory, max(l_partkey) AS priority FROM lineitem GROUP BY 1, 2, 3) "
for _p, _o in {"fifo": "step", "priority": "priority DESC, step", "resource_aware": "cpu DESC, memory DESC, step"}.items():
    query(f"sched_{_p}", _QUEUE + f"SELECT queue, step, CAST(row_number() OVER (PARTITION BY queue ORDER BY {_o}) AS INTEGER) AS turn FROM q", views=False)(lambda s, d, p=_p: scheduling.pick_order(_queue(s, d), p).select("queue", "step", "turn"))


@query("sched_fair", _QUEUE + ", r AS (SELECT *, row_number() OVER (PARTITION BY queue, trial ORDER BY step) AS rnd FROM q) SELECT queue, step, CAST(row_number() OVER (PARTITION BY queue ORDER BY rnd, trial, step) AS INTEGER) AS turn FROM r", views=False)
def sched_fair(s, d):
    return scheduling.pick_order(_queue(s, d), "fair").select("queue", "step", "turn")


@query("resource_usage", _QUEUE + "SELECT queue, sum(cpu) AS cpu, sum(memory) AS memory FROM q GROUP BY 1", views=False)
def resource_usage(s, d):
    return scheduling.usage(_queue(s, d), "queue")


@query("backoff_delays", "SELECT trial_id, 5.0::DOUBLE * pow(2.0, attempt) AS exponential, 5.0::DOUBLE * attempt AS linear FROM results")
def backoff_delays(s, d):
    return V.trial_results(s, d).select("trial_id", scheduling.backoff(F.col("attempt"), "exponential", 5.0).alias("exponential"), scheduling.backoff(F.col("attempt"), "linear", 5.0).alias("linear"))


@query("fingerprints", "SELECT trial_id, sha256(concat_ws('|', 'order.priority', value)) AS fingerprint FROM assignments")
def fingerprints(s, d):
    a = V.assignments(s, d)
    return a.select("trial_id", F.sha2(F.concat_ws("|", F.concat_ws(".", "element", "parameter"), "value"), 256).alias("fingerprint"))


from . import catalog_records  # noqa: E402,F401 - registers further queries here
from . import catalog_live  # noqa: E402,F401 - registers further queries here
from . import catalog_values  # noqa: E402,F401 - registers further queries here
from . import catalog_sources  # noqa: E402,F401 - registers further queries here
from . import catalog_access  # noqa: E402,F401 - registers further queries here
