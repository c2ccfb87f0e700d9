"""Queries over accessors, resources, instances, checkpoints, tokens and axes, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _elements, query
from .operators import accessors
from .plans import grid, lifecycle
from .sources import views as V
from .sources.checkpoints import Checkpoints, Suspensions
from .sources.shared import new_folder

# ---- assignments and metrics -----------------------------------------------------------------------------------------


@query("metric_get", "SELECT trial_id, discount AS value_num FROM wide WHERE trial_id % 3 = 1")
def metric_get(s, d):
    return accessors.get(V.trial_metrics(s, d), "line", "discount").where("trial_id % 3 = 1").select("trial_id", "value_num")


@query("metric_sizes", "SELECT trial_id, CASE WHEN quantity IS NULL THEN 0 ELSE 3 END::BIGINT AS entries, CASE WHEN quantity IS NULL THEN 0 ELSE 1 END::BIGINT AS elements, quantity IS NULL AS empty FROM results LEFT JOIN wide USING (trial_id)")
def metric_sizes(s, d):
    """Every trial's number of metrics, those without any included."""
    return accessors.sizes(V.trial_results(s, d), V.trial_metrics(s, d))


@query(
    "assignment_problems",
    "SELECT o_orderkey AS trial_id, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'order' END AS element, 'priority' AS parameter, CASE WHEN o_orderkey % 6 = 0 THEN 'no element' ELSE 'addressed to another parameter' END AS problem FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 10 = 5"
    " UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'order' END, 'priority', 'assigned twice' FROM orders WHERE o_custkey % 9 = 0",
    views=False,
)
def assignment_problems(s, d):
    o = V.table(s, d, "orders")
    k = F.col("o_orderkey")
    a = o.select(k.alias("trial_id"), F.when(k % 6 == 0, "").otherwise("order").alias("element"), F.lit("priority").alias("parameter"), F.when(k % 10 == 5, "state").otherwise("priority").alias("value_parameter"), F.col("o_custkey").alias("c"))
    again = a.where("c % 9 = 0").withColumn("value_parameter", F.lit("priority"))
    found = accessors.assignment_problems(a.unionByName(again).drop("c"))
    return found.distinct()


# ---- resources and instances -------------------------------------------------------------------------------------------


@query(
    "resource_usage_custom",
    "WITH q AS (SELECT l_suppkey AS pool, count(*) AS active, sum(l_linenumber)::BIGINT AS cpu, sum(CAST(l_quantity AS BIGINT))::BIGINT AS memory, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 2 END)::BIGINT AS storage, count(*) AS network, sum(l_linenumber) FILTER (l_linestatus = 'O')::BIGINT AS o, sum(l_linenumber) FILTER (l_linestatus = 'F')::BIGINT AS f, count(*) AS tokens FROM lineitem GROUP BY 1) SELECT pool, active, cpu, memory, storage, network, o AS gpu_o, f AS gpu_f, tokens FROM q",
    views=False,
)
def resource_usage_custom(s, d):
    li = V.table(s, d, "lineitem")
    rows = li.select(
        F.col("l_suppkey").alias("pool"), F.col("l_linenumber").cast("bigint").alias("cpu"), F.col("l_quantity").cast("bigint").alias("memory"), F.when(F.col("l_returnflag") != "R", F.lit(2)).cast("bigint").alias("storage"), F.lit(1).cast("bigint").alias("network"),
        F.create_map(F.concat(F.lit("gpu_"), F.lower("l_linestatus")), F.col("l_linenumber").cast("bigint"), F.lit("tokens"), F.lit(1).cast("bigint")).alias("custom"),
    )
    used = accessors.resource_usage(rows, "pool")
    return used.select("pool", "active", "cpu", "memory", "storage", "network", *[F.col("custom")[k].alias(k) for k in ("gpu_o", "gpu_f", "tokens")])


_INSTANCES = "WITH RECURSIVE e AS (SELECT s_suppkey AS k, s_suppkey // 2 AS up FROM supplier), i AS (SELECT 'e' || k || ':' || g AS instance, 'e' || k AS element, k, up, g FROM e, range(0, 3) t(g)), l AS (SELECT 'e' || up || ':' || g AS src, instance AS dst FROM i WHERE up IN (SELECT k FROM e) AND up <> k), p AS (SELECT instance, 0 AS depth FROM i UNION SELECT l.dst, p.depth + 1 FROM p JOIN l ON l.src = p.instance) "


def _instances(s, d):
    """Three instances of every supplier; each needs that of the supplier of half its number."""
    e, links = _elements(s, d)
    groups = F.explode(F.array(*[F.lit(g) for g in range(3)])).alias("grp")
    name = lambda c: F.concat_ws(":", F.col(c), F.col("grp").cast("string"))
    nodes = e.select("element", groups).select(name("element").alias("instance"), "element", "grp")
    edges = links.select("src", "dst", "kind", groups).select(name("dst").alias("src"), name("src").alias("dst"), "kind")
    return nodes, edges


@query("instance_summary", _INSTANCES + "SELECT i.instance, i.element, (SELECT count(*) FROM l WHERE l.src = i.instance) AS outgoing, (SELECT count(*) FROM l WHERE l.dst = i.instance) AS incoming, max(p.depth) AS depth FROM i JOIN p USING (instance) GROUP BY 1, 2", views=False)
def instance_summary(s, d):
    return accessors.instance_summary(*_instances(s, d))


@query("instance_problems", "SELECT 'dangling' AS problem, 'e' || s_suppkey || ':' || g AS node FROM supplier, range(0, 3) t(g) WHERE s_suppkey % 10 = 3 AND (s_suppkey // 2 > 0 OR s_suppkey * 2 <= (SELECT max(s_suppkey) FROM supplier))", views=False)
def instance_problems(s, d):
    """Edges whose instances were taken away."""
    nodes, edges = _instances(s, d)
    return accessors.instance_problems(nodes.where("substr(element, 2) % 10 <> 3"), edges)


@query(
    "plan_diagnostics",
    "WITH l AS (SELECT 'e' || s_suppkey AS src, 'e' || s_suppkey // 2 AS dst, CASE s_suppkey % 4 WHEN 0 THEN 'shared' WHEN 3 THEN 'loose' ELSE 'exclusive' END AS kind FROM supplier)"
    " SELECT 'undeclared' AS problem, src AS element, dst AS other FROM l WHERE dst NOT IN (SELECT src FROM l) UNION ALL SELECT 'needs itself', src, dst FROM l WHERE src = dst UNION ALL SELECT 'unsupported kind', src, dst FROM l WHERE kind = 'loose'"
    " UNION ALL SELECT 'exclusive use by several', src, dst FROM l WHERE kind = 'exclusive' AND dst IN (SELECT dst FROM l WHERE kind = 'exclusive' GROUP BY 1 HAVING count(DISTINCT src) > 1)",
    views=False,
)
def plan_diagnostics(s, d):
    e, _ = _elements(s, d)
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "shared").when(k % 4 == 3, "loose").otherwise("exclusive")
    links = V.table(s, d, "supplier").select(F.concat(F.lit("e"), k.cast("string")).alias("src"), F.concat(F.lit("e"), F.expr("s_suppkey div 2").cast("string")).alias("dst"), kind.alias("kind"))
    return lifecycle.diagnostics(e, links)


# ---- checkpoints and suspensions -----------------------------------------------------------------------------------------

_SAVED = "WITH c AS (SELECT o_custkey AS execution_id, o_orderkey AS checkpoint_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN 'again' ELSE o_orderpriority END AS body FROM orders WHERE o_orderkey % 6 <> 1) "


def _saved(s, d):
    """All orders saved, every fourth again with another body, every sixth deleted."""
    o = V.table(s, d, "orders").select(F.col("o_custkey").alias("execution_id"), F.col("o_orderkey").alias("checkpoint_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("body"))
    store = Checkpoints(s, new_folder(s, "checkpoints"))
    store.save(o)
    store.save(o.where("checkpoint_id % 4 = 0").withColumn("body", F.lit("again")))
    store.delete(o.where("checkpoint_id % 6 = 1"))
    return store


@query("checkpoint_saved", _SAVED + "SELECT * FROM c", views=False)
def checkpoint_saved(s, d):
    return _saved(s, d).all()


@query("checkpoint_pruned", _SAVED + "SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, checkpoint_id DESC) <= 2", views=False)
def checkpoint_pruned(s, d):
    store = _saved(s, d)
    store.prune(2)
    return store.all()


@query("suspension_upsert", "SELECT o_custkey AS execution_id, max(o_orderdate) AS suspended_at FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1", views=False)
def suspension_upsert(s, d):
    """Executions are suspended by each order in turn of its priority; a third is resumed."""
    o = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("execution_id")).agg(F.min("o_orderdate").alias("suspended_at"), F.max("o_orderdate").alias("_last"))
    store = Suspensions(s, new_folder(s, "suspensions"))
    store.suspend(o.select("execution_id", "suspended_at", F.lit("first").alias("body")))
    store.suspend(o.select("execution_id", F.col("_last").alias("suspended_at"), F.lit("last").alias("body")))
    store.resume(o.where("execution_id % 3 = 0"))
    return store.all().select("execution_id", "suspended_at")


# ---- tokens by target, axes -----------------------------------------------------------------------------------------------


@query(
    "token_fall_through",
    "WITH n AS (SELECT o_orderkey AS trial, 'e' || o_orderkey % 8 AS element, p.parameter FROM orders, (VALUES ('size'), ('mode'), ('place')) p(parameter))"
    " SELECT trial, element, parameter, CASE parameter WHEN 'size' THEN CASE trial % 8 % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'plain' ELSE 'fallback' END WHEN 'mode' THEN CASE trial % 8 % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'plain' ELSE 'config' END END AS value,"
    " CASE parameter WHEN 'size' THEN CASE WHEN trial % 8 % 4 < 2 THEN 'binding' ELSE 'default' END WHEN 'mode' THEN CASE WHEN trial % 8 % 4 < 2 THEN 'binding' ELSE 'config' END ELSE 'unresolved' END AS source FROM n",
    views=False,
)
def token_fall_through(s, d):
    """Bindings that are tokens: by key and parameter, by key alone, unknown, and more than a token."""
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("trial"), F.concat(F.lit("e"), (F.col("o_orderkey") % 8).cast("string")).alias("element"))
    need = o.select("trial", "element", F.explode(F.array(F.lit("size"), F.lit("mode"), F.lit("place"))).alias("parameter"))
    elements = o.select("element").distinct()
    lane = F.substring("element", 2, 2).cast("int") % 4
    bound = F.when(lane == 0, "${key}").when(lane == 1, "plain").when(lane == 2, "${unknown}").otherwise("${a${b}}")
    bindings = elements.select("element", F.explode(F.array(F.lit("size"), F.lit("mode"))).alias("parameter"), bound.alias("value"))
    configs = elements.select("element", F.lit("mode").alias("parameter"), F.lit("config").alias("value"))
    defaults = elements.select("element", F.lit("size").alias("parameter"), F.lit("fallback").alias("value")).unionByName(elements.select("element", F.lit("place").alias("parameter"), F.lit("${nowhere}").alias("value")))
    tokens = s.createDataFrame([("key", "size", "large"), ("key", None, "any"), ("other", None, "x")], "key string, parameter string, text string")
    none = need.where("false").withColumn("value", F.lit(None).cast("string"))
    return grid.resolve(need, none, bindings, configs, defaults, tokens)


_BRAND_AXES = "WITH v AS (SELECT p_brand AS axis, p_size AS value, p_partkey FROM part), e AS (SELECT DISTINCT p_brand AS axis, p_size + CASE WHEN p_partkey % 50 = 0 THEN 1000 ELSE 0 END AS value FROM part WHERE p_partkey % 10 = 0) "


def _brand_axes(s, d):
    """Every brand an axis of its parts' sizes; every tenth part names an explicit edge, some of them no size."""
    p = V.table(s, d, "part")
    values = p.select(F.col("p_brand").alias("axis"), F.lit("integer").alias("kind"), F.col("p_size").alias("value"))
    edges = p.where("p_partkey % 10 = 0").select(F.col("p_brand").alias("axis"), F.lit("integer").alias("kind"), (F.col("p_size") + F.when(F.col("p_partkey") % 50 == 0, 1000).otherwise(0)).alias("value"))
    return values, edges.distinct()


@query("axis_boundaries", _BRAND_AXES + "SELECT axis, value FROM e UNION SELECT axis, unnest([min(value), max(value)]) AS value FROM v WHERE axis NOT IN (SELECT axis FROM e) GROUP BY 1", views=False)
def axis_boundaries(s, d):
    values, edges = _brand_axes(s, d)
    return grid.axis_boundaries(values.withColumn("place", F.col("value")), edges)


@query(
    "axis_problems",
    _BRAND_AXES + ", n AS (SELECT DISTINCT axis, CAST(substr(axis, 7) AS INTEGER) AS k FROM v) SELECT DISTINCT axis, 'repeated values' AS problem FROM (SELECT axis, value FROM v GROUP BY 1, 2 HAVING count(*) > 1)"
    " UNION ALL SELECT DISTINCT axis, 'boundary values outside the axis' FROM e WHERE (axis, value) NOT IN (SELECT (axis, value) FROM v) UNION ALL SELECT axis, 'target of several axes' FROM n WHERE k % 10 IN (1, 2)"
    " UNION ALL SELECT axis, 'unknown parameter' FROM n WHERE k % 10 = 3 UNION ALL SELECT axis, 'derived parameter' FROM n WHERE k % 10 = 4 UNION ALL SELECT axis, 'values of another kind' FROM n WHERE k % 10 = 5 UNION ALL SELECT axis, 'both axis and binding' FROM n WHERE k % 10 IN (1, 2)",
    views=False,
)
def axis_problems(s, d):
    values, edges = _brand_axes(s, d)
    n = values.select("axis").distinct().withColumn("k", F.substring("axis", 7, 9).cast("int"))
    tenth = F.col("k") % 10
    parameter = F.concat(F.lit("p"), F.when(tenth == 2, F.col("k") - 1).otherwise(F.col("k")).cast("string"))
    axes = n.select("axis", F.lit("part").alias("element"), parameter.alias("parameter"))
    parameters = n.where(tenth != 3).select(F.lit("part").alias("element"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("parameter"), F.when(tenth == 5, "double").otherwise("integer").alias("kind"), (tenth == 4).alias("derived"))
    bindings = n.where(tenth == 1).select(F.lit("part").alias("element"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("parameter"))
    return grid.axis_problems(axes, values, edges, parameters, bindings)
