"""Queries over stored records, graphs and grids that complete the catalog, with the SQL that states their results."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _ID, _LINES, SCHEMA, Q, _lines, query
from .functions import domains as D
from .functions.expressions import Call, If, compile_expr, lift
from .operators import graph, records, wiring
from .operators.filters import apply_filter, where
from .plans import grid, lifecycle
from .sources import codec, store
from .sources import views as V
from .streaming import journal as J

# ---- plans, executions, artifacts ----------------------------------------------------------------------------------

_PLANS = (
    "WITH plans AS (SELECT p_partkey AS plan_id, sha256(p_name) AS fingerprint, p_name AS name, TIMESTAMP '1995-01-01' + to_days(p_size) AS compiled_at, p_brand AS brand, p_type AS type FROM part),"
    " executions AS (SELECT o_orderkey AS execution_id, sha256(o_orderpriority) AS plan_fingerprint, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, o_orderdate AS started_at, o_orderpriority AS priority, o_custkey % 10 AS lane FROM orders) "
)


def _plans(s, d):
    p = V.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("plan_id"), F.sha2("p_name", 256).alias("fingerprint"), F.col("p_name").alias("name"), (F.lit(dt.datetime(1995, 1, 1)) + F.make_dt_interval(F.col("p_size"))).alias("compiled_at"), F.create_map(F.lit("brand"), "p_brand").alias("labels"), F.create_map(F.lit("type"), "p_type").alias("tags"))


def _executions(s, d):
    r = V.trial_results(s, d).select(F.col("trial_id").alias("execution_id"), "status", "started_at", (F.col("execution_id") % 10).cast("string").alias("lane"))
    p = V.assignments(s, d).select(F.col("trial_id").alias("execution_id"), F.col("value").alias("priority"))
    return r.join(p, "execution_id").select("execution_id", F.sha2("priority", 256).alias("plan_fingerprint"), "status", "started_at", F.create_map(F.lit("priority"), "priority").alias("labels"), F.create_map(F.lit("lane"), "lane").alias("tags"))


@query("plan_filter", _PLANS + "SELECT plan_id FROM plans WHERE contains(name, 'red') AND compiled_at > TIMESTAMP '1995-01-06' AND compiled_at < TIMESTAMP '1995-02-10' AND type = 'ECONOMY'", views=False)
def plan_filter(s, d):
    return records.PlanFilter(None, "red", dt.datetime(1995, 1, 6), dt.datetime(1995, 2, 10), tags={"type": "ECONOMY"}).apply(_plans(s, d)).select("plan_id")


@query("plan_filter_labels", _PLANS + "SELECT plan_id, fingerprint FROM plans WHERE brand = 'Brand#12'", views=False)
def plan_filter_labels(s, d):
    return records.PlanFilter(labels={"brand": "Brand#12"}).apply(_plans(s, d)).select("plan_id", "fingerprint")


@query("plan_by_fingerprint", _PLANS + "SELECT plan_id, name FROM plans WHERE fingerprint = sha256('red widget')", views=False)
def plan_by_fingerprint(s, d):
    return records.PlanFilter(hashlib.sha256(b"red widget").hexdigest()).apply(_plans(s, d)).select("plan_id", "name")


@query("execution_filter", _PLANS + "SELECT execution_id FROM executions WHERE plan_fingerprint = sha256('2-HIGH') AND status = 'failed' AND started_at > TIMESTAMP '1994-01-01' AND started_at < TIMESTAMP '1997-01-01' AND priority = '2-HIGH' AND lane IN (3)", views=False)
def execution_filter(s, d):
    f = records.ExecutionFilter(hashlib.sha256(b"2-HIGH").hexdigest(), "failed", dt.datetime(1994, 1, 1), dt.datetime(1997, 1, 1), {"priority": "2-HIGH"}, {"lane": "3"})
    return f.apply(_executions(s, d)).select("execution_id")


@query("filter_plan_fingerprint", _PLANS + "SELECT execution_id AS trial_id FROM executions WHERE NOT plan_fingerprint = sha256('5-LOW')", views=False)
def filter_plan_fingerprint(s, d):
    e = _executions(s, d).withColumnRenamed("execution_id", "trial_id")
    return apply_filter(e, ~where("plan_fingerprint", hashlib.sha256(b"5-LOW").hexdigest())).select("trial_id")


@query("latest_execution", _PLANS + "SELECT plan_fingerprint, execution_id, started_at FROM executions QUALIFY row_number() OVER (PARTITION BY plan_fingerprint ORDER BY started_at DESC, execution_id DESC) = 1", views=False)
def latest_execution(s, d):
    return records.latest_execution(_executions(s, d))


_ARTIFACTS = "WITH artifacts AS (SELECT o_orderkey AS artifact_id, o_custkey AS execution_id, o_orderkey % 7 AS trial_id, o_orderstatus AS element, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'inline' END AS content, CASE WHEN o_orderkey % 3 = 1 THEN 'fetched' END AS fetched FROM orders) "


def _artifact_rows(s, d):
    k = F.col("o_orderkey")
    return V.table(s, d, "orders").select(
        k.alias("artifact_id"), F.col("o_custkey").alias("execution_id"), (k % 7).alias("trial_id"), F.col("o_orderstatus").alias("element"), F.col("o_orderpriority").alias("name"),
        F.when(k % 3 == 0, F.lit("inline").cast("binary")).alias("content"), F.when(k % 3 == 1, F.lit("fetched").cast("binary")).alias("fetched"),
    )


@query("artifact_filter", _ARTIFACTS + "SELECT artifact_id FROM artifacts WHERE trial_id = 3 AND element = 'O'", views=False)
def artifact_filter(s, d):
    return records.artifacts_of(_artifact_rows(s, d), None, 3, "O").select("artifact_id")


@query("artifact_payload", _ARTIFACTS + "SELECT artifact_id, coalesce(content, fetched, '') AS payload FROM artifacts", views=False)
def artifact_payload(s, d):
    return store.payload(_artifact_rows(s, d)).select("artifact_id", F.col("payload").cast("string").alias("payload"))


_KEY = "execution_id, trial_id, element, name"


@query("artifact_replace", _ARTIFACTS + f"SELECT artifact_id FROM artifacts a WHERE artifact_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM artifacts b WHERE b.artifact_id % 2 = 1 AND (a.execution_id, a.trial_id, a.element, a.name) = (b.execution_id, b.trial_id, b.element, b.name)) UNION ALL SELECT artifact_id FROM artifacts WHERE artifact_id % 2 = 1", views=False)
def artifact_replace(s, d):
    a = _artifact_rows(s, d)
    return store.save_artifacts(a.where("artifact_id % 2 = 0"), a.where("artifact_id % 2 = 1"), "replace").select("artifact_id")


@query("artifact_version", _ARTIFACTS + "SELECT artifact_id, element FROM artifacts", views=False)
def artifact_version(s, d):
    a = _artifact_rows(s, d)
    return store.save_artifacts(a.where("artifact_id % 2 = 0"), a.where("artifact_id % 2 = 1"), "version").select("artifact_id", "element")


@query("artifact_delete", _ARTIFACTS + "SELECT artifact_id FROM artifacts WHERE element <> 'P'", views=False)
def artifact_delete(s, d):
    a = _artifact_rows(s, d)
    return records.without(a, a.where("element = 'P'"), "artifact_id").select("artifact_id")


# ---- results -------------------------------------------------------------------------------------------------------

_FULL = (
    ", full_results AS (SELECT *, CASE WHEN status = 'failed' AND trial_id % 7 <> 0 OR trial_id % 11 = 0 THEN 'x' END AS error, CASE WHEN status = 'skipped' AND trial_id % 5 <> 0 OR trial_id % 13 = 0 THEN 'up' END AS skip_reason,"
    " started_at + to_hours(CAST(trial_id % 9 - 1 AS BIGINT)) AS completed_at, CASE WHEN trial_id % 17 = 0 THEN 0 ELSE attempt END AS tries FROM results) "
)


def _full(s, d):
    r, i = V.trial_results(s, d), F.col("trial_id")
    failed, skipped = F.col("status") == "failed", F.col("status") == "skipped"
    return r.withColumns(
        {
            "error": F.when((failed & (i % 7 != 0)) | (i % 11 == 0), "x"), "skip_reason": F.when((skipped & (i % 5 != 0)) | (i % 13 == 0), "up"),
            "completed_at": F.col("started_at") + F.make_dt_interval(F.lit(0), (i % 9 - 1).cast("int")), "attempt": F.when(i % 17 == 0, 0).otherwise(F.col("attempt")),
        }
    )


@query(
    "result_violations",
    _FULL + "SELECT trial_id, list_filter([CASE WHEN tries < 1 THEN 'attempt is zero' END, CASE WHEN status = 'failed' AND error IS NULL THEN 'failure without error' END, CASE WHEN status = 'skipped' AND skip_reason IS NULL THEN 'skip without reason' END,"
    " CASE WHEN status <> 'failed' AND error IS NOT NULL THEN 'error without failure' END, CASE WHEN status <> 'skipped' AND skip_reason IS NOT NULL THEN 'reason without skip' END, CASE WHEN completed_at < started_at THEN 'ends before it starts' END], lambda x: x IS NOT NULL) AS violations FROM full_results",
)
def result_violations(s, d):
    return _full(s, d).select("trial_id", records.result_violations().alias("violations"))


@query("result_duration", _FULL + "SELECT trial_id, (trial_id % 9 - 1) * 3600.0::DOUBLE AS seconds FROM full_results")
def result_duration(s, d):
    return _full(s, d).select("trial_id", records.duration_seconds(F.col("started_at"), F.col("completed_at")).alias("seconds"))


_STATUS = "CASE WHEN kind = 'step_completed' THEN 'completed' WHEN kind = 'step_failed' THEN 'failed' WHEN kind = 'step_skipped' THEN 'cancelled' WHEN kind = 'step_started' THEN 'in_progress' END"


@query("status_predicates", f"SELECT event_id, coalesce(st IN ('completed', 'failed', 'skipped', 'cancelled'), false) AS terminal, coalesce(st = 'completed', false) AS success, coalesce(st = 'failed', false) AS failure FROM (SELECT event_id, {_STATUS} AS st FROM journal)")
def status_predicates(s, d):
    kinds = {"step_completed": "completed", "step_failed": "failed", "step_skipped": "cancelled", "step_started": "in_progress"}
    st = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    return V.journal(s, d).select("event_id", records.is_terminal(st).alias("terminal"), records.is_success(st).alias("success"), records.is_failure(st).alias("failure"))


def _documents(s, d):
    w = V.trial_metrics(s, d).groupBy("trial_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "element", "parameter"), "value_num")))).alias("metrics"))
    r = V.trial_results(s, d).join(w, "trial_id", "left")
    return r.select("trial_id", "status", "attempt", "started_at", "metrics", F.array("status", "code").alias("path"))


@query("json_round_trip", "SELECT trial_id, status, attempt, started_at, quantity, code FROM results LEFT JOIN wide USING (trial_id)")
def json_round_trip(s, d):
    docs = _documents(s, d)
    again = codec.decode(codec.encode(docs, "trial_id"), docs.schema)
    return again.select("trial_id", "status", "attempt", "started_at", F.col("metrics")["line.quantity"].alias("quantity"), F.col("path")[1].alias("code"))


@query("explode_metrics", "SELECT trial_id, 'line' AS element, parameter, value_num FROM (UNPIVOT wide ON quantity, price, discount INTO NAME parameter VALUE value_num)")
def explode_metrics(s, d):
    return store.explode_metrics(_documents(s, d))


@query("result_delete", "SELECT trial_id FROM results WHERE status <> 'skipped'")
def result_delete(s, d):
    r = V.trial_results(s, d)
    return records.without(r, r.where("status = 'skipped'"), "trial_id").select("trial_id")


@query("page_token", "WITH r AS (SELECT o_orderkey AS trial_id FROM orders WHERE o_orderkey > 200 ORDER BY 1 LIMIT 30) SELECT trial_id, (SELECT max(trial_id) FROM r) AS next_token FROM r", views=False)
def page_token(s, d):
    return records.page_with_token(V.trial_results(s, d).select("trial_id"), "trial_id", 200, 30)


@query("page_last_token", "SELECT n_nationkey AS id, CAST(NULL AS INTEGER) AS next_token FROM nation WHERE n_nationkey > 10", views=False)
def page_last_token(s, d):
    return records.page_with_token(V.table(s, d, "nation").select(F.col("n_nationkey").alias("id")), "id", 10, 1000)


@query("assignment_checks", "SELECT trial_id FROM assignments WHERE trial_id % 6 = 0 OR trial_id % 4 = 1")
def assignment_checks(s, d):
    a, i = V.assignments(s, d), F.col("trial_id")
    a = a.withColumns({"element": F.when(i % 6 != 0, F.col("element")), "value_parameter": F.when(i % 4 == 1, "other").otherwise(F.col("parameter"))})
    return records.misaddressed(a).select("trial_id")


@query("value_tampered", "SELECT trial_id, trial_id % 8 <> 0 AS intact FROM assignments")
def value_tampered(s, d):
    a, i = V.assignments(s, d), F.col("trial_id")
    stored = a.withColumn("fingerprint", records.value_fingerprint(F.lit("string"), F.col("value")))
    changed = stored.withColumn("value", F.when(i % 8 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return changed.select("trial_id", records.intact(F.lit("string"), F.col("value"), F.col("fingerprint")).alias("intact"))


# ---- elements, metadata, checkpoints -------------------------------------------------------------------------------

_ELEMENTS = "WITH e AS (SELECT p_partkey, 'p' || p_partkey AS element, p_type, p_size, p_partkey % 10 AS lane FROM part) "


@query(
    "element_violations",
    _ELEMENTS + "SELECT element, list_filter([CASE WHEN lane = 0 THEN 'no type label' END, CASE WHEN lane <> 0 AND p_type NOT IN ('ECONOMY', 'SMALL') THEN 'unknown type' END, CASE WHEN lane <> 0 AND p_type = 'ECONOMY' AND p_size % 2 = 1 THEN 'required label missing' END,"
    " CASE WHEN lane <> 0 AND p_type = 'SMALL' AND p_size % 2 = 0 THEN 'forbidden label' END, CASE WHEN lane = 1 THEN 'repeated parameter' END, CASE WHEN lane = 8 THEN 'repeated result parameter' END, CASE WHEN lane = 2 THEN 'configuration of no parameter' END, CASE WHEN lane IN (7, 9) THEN 'repeated port' END, CASE WHEN lane IN (3, 9) THEN 'name in two tiers' END,"
    " CASE WHEN lane = 4 THEN 'parameter named like an attribute' END, CASE WHEN lane = 5 THEN 'concurrency below one' END, CASE WHEN lane = 6 THEN 'group concurrency above all' END], lambda x: x IS NOT NULL) AS violations FROM e",
    views=False,
)
def element_violations(s, d):
    lane, size = F.col("p_partkey") % 10, F.col("p_size")
    e = V.table(s, d, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("element"),
        F.map_filter(F.create_map(F.lit("type"), F.when(lane != 0, F.col("p_type")), F.lit("even"), F.when(size % 2 == 0, "y")), lambda k, v: v.isNotNull()).alias("labels"),
        F.create_map(F.lit("team"), F.lit("a")).alias("tags"),
        F.when(lane == 3, F.array(F.lit("team"))).when(lane == 7, F.array(F.lit("in"), F.lit("in"))).when(lane == 9, F.array(F.lit("team"), F.lit("in"), F.lit("team"))).otherwise(F.array(F.lit("in"))).alias("ports"),
        F.when(lane == 8, F.array(F.lit("r"), F.lit("r"))).when(lane < 5, F.array(F.lit("r"), F.lit("q"))).alias("result_parameters"),
        F.when(lane == 1, F.array(F.lit("x"), F.lit("x"))).when(lane == 4, F.array(F.lit("x"), F.lit("in"))).otherwise(F.array(F.lit("x"))).alias("parameters"),
        F.when(lane == 2, F.array(F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("config_keys"),
        F.when(lane == 5, 0).when(lane == 6, 2).alias("max_concurrency"), F.when(lane == 6, 3).alias("max_group_concurrency"),
    )
    types = s.createDataFrame([("ECONOMY", ["even"], []), ("SMALL", [], ["even"])], "type string, required array<string>, forbidden array<string>")
    return records.element_violations(e, types)


def _metadata(s, d):
    c = V.table(s, d, "customer")
    scope = F.when(F.col("c_nationkey") % 2 == 0, "execution_plan").otherwise("trial")
    return c.select(scope.alias("scope"), F.col("c_custkey").alias("id"), F.to_json(F.struct("c_name")).alias("body"), F.create_map(F.lit("segment"), "c_mktsegment").alias("labels"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("tags"))


_METADATA = (
    "WITH m AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'execution_plan' ELSE 'trial' END AS scope, c_custkey AS id, '{\"c_name\":\"' || c_name || '\"}' AS body, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer), "
    "k AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'artifact' ELSE 'trial' END AS scope, s_suppkey - 7 AS id, s_name FROM supplier) "
)


def _suppliers(s, d):
    """Keys of which some have a record already and some have none."""
    k = V.table(s, d, "supplier")
    return k.select(F.when(F.col("s_suppkey") % 2 == 0, "artifact").otherwise("trial").alias("scope"), (F.col("s_suppkey") - 7).alias("id"), F.col("s_name").alias("name"))


@query(
    "metadata_upsert",
    _METADATA + "SELECT coalesce(m.scope, k.scope) AS scope, coalesce(m.id, k.id) AS id, coalesce('{\"by\":\"' || s_name || '\"}', body) AS body, segment, nation FROM m FULL JOIN k ON k.scope = m.scope AND k.id = m.id",
    views=False,
)
def metadata_upsert(s, d):
    """Bodies are replaced and made; labels and tags of records that exist stay."""
    new = _suppliers(s, d).select("scope", "id", F.to_json(F.struct(F.col("name").alias("by"))).alias("body"))
    return records.put_metadata(_metadata(s, d), new).select("scope", "id", "body", F.col("labels")["segment"].alias("segment"), F.col("tags")["nation"].alias("nation"))


@query(
    "metadata_set_labels",
    _METADATA + "SELECT coalesce(m.scope, k.scope) AS scope, coalesce(m.id, k.id) AS id, coalesce(body, '{}') AS body, CASE WHEN s_name IS NULL THEN segment END AS segment, s_name AS tier, nation FROM m FULL JOIN k ON k.scope = m.scope AND k.id = m.id",
    views=False,
)
def metadata_set_labels(s, d):
    """Labels are replaced whole; keys without a record get one."""
    changes = _suppliers(s, d).select("scope", "id", F.create_map(F.lit("tier"), "name").alias("entries"))
    got = records.set_map(_metadata(s, d), "labels", changes)
    return got.select("scope", "id", "body", F.col("labels")["segment"].alias("segment"), F.col("labels")["tier"].alias("tier"), F.col("tags")["nation"].alias("nation"))


@query("metadata_list", "SELECT c_custkey AS id FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey > 40 ORDER BY 1 LIMIT 25", views=False)
def metadata_list(s, d):
    return records.list_scope(_metadata(s, d), "execution_plan", 40, 25).select("id")


_CHECKPOINTS = "WITH c AS (SELECT o_custkey AS execution_id, o_orderkey AS checkpoint_id, o_orderdate AS created_at FROM orders) SELECT execution_id, checkpoint_id, created_at FROM c QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, checkpoint_id DESC) <= {}"


def _checkpoints(s, d):
    return V.table(s, d, "orders").select(F.col("o_custkey").alias("execution_id"), F.col("o_orderkey").alias("checkpoint_id"), F.col("o_orderdate").alias("created_at"))


@query("checkpoint_latest", _CHECKPOINTS.format(1), views=False)
def checkpoint_latest(s, d):
    return records.latest_checkpoint(_checkpoints(s, d))


@query("checkpoint_prune", _CHECKPOINTS.format(2), views=False)
def checkpoint_prune(s, d):
    return records.prune_checkpoints(_checkpoints(s, d), 2)


@query("clean_up", "SELECT 'result' AS record, trial_id AS id FROM results JOIN customer ON c_custkey = execution_id WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'checkpoint', o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'")
def clean_up(s, d):
    gone = V.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("execution_id"))
    left = records.clean_up({"result": V.trial_results(s, d), "checkpoint": _checkpoints(s, d)}, gone)
    return left["result"].select(F.lit("result").alias("record"), F.col("trial_id").alias("id")).unionByName(left["checkpoint"].select(F.lit("checkpoint").alias("record"), F.col("checkpoint_id").alias("id")))


# ---- journal -------------------------------------------------------------------------------------------------------


@query("journal_delete", "SELECT execution_id, sequence FROM journal WHERE execution_id % 4 <> 0")
def journal_delete(s, d):
    j = V.journal(s, d)
    return J.delete_all(j, j.where("execution_id % 4 = 0")).select("execution_id", "sequence")


@query("journal_is_completed", "SELECT DISTINCT execution_id, step_id, EXISTS (SELECT 1 FROM journal k WHERE k.execution_id = j.execution_id AND k.step_id = j.step_id AND k.kind = 'step_completed') AS completed FROM journal j WHERE kind = 'step_started'")
def journal_is_completed(s, d):
    j = V.journal(s, d)
    return J.is_completed(j, j.where("kind = 'step_started'").select("execution_id", "step_id").distinct())


@query("journal_last_overall", "SELECT execution_id, sequence, kind FROM journal ORDER BY sequence DESC, execution_id DESC LIMIT 1")
def journal_last_overall(s, d):
    return J.last_overall(V.journal(s, d)).select("execution_id", "sequence", "kind")


@query("step_idempotency", "SELECT event_id, CASE WHEN step IN ('deploy', 'await', 'save_output') THEN 'idempotent' ELSE 'non_idempotent' END AS class FROM (SELECT event_id, CASE kind WHEN 'step_started' THEN 'deploy' WHEN 'step_completed' THEN 'save_output' WHEN 'step_failed' THEN 'teardown' ELSE 'barrier' END AS step FROM journal)")
def step_idempotency(s, d):
    step = F.when(F.col("kind") == "step_started", "deploy").when(F.col("kind") == "step_completed", "save_output").when(F.col("kind") == "step_failed", "teardown").otherwise("barrier")
    return V.journal(s, d).select("event_id", records.idempotency(step).alias("class"))


# ---- graphs --------------------------------------------------------------------------------------------------------


@query("dag_neighbours", "SELECT dst AS node, 'dependency' AS relation, src AS other FROM edge WHERE starts_with(dst, 'n') UNION SELECT src, 'dependent', dst FROM edge WHERE starts_with(src, 'n')")
def dag_neighbours(s, d):
    n, e = V.dag(s, d)
    return graph.neighbours(e, n.where("node like 'n%'"))


@query("dag_subgraph", "SELECT src, dst FROM edge WHERE src NOT LIKE 'r%' AND dst NOT LIKE 'r%'")
def dag_subgraph(s, d):
    n, e = V.dag(s, d)
    return graph.subgraph(n, e, ~F.startswith(F.col("node"), F.lit("r")))[1]




#: the longest path to each node, from the edges alone
_DEPTHS = ", paths AS (SELECT node, 0 AS depth FROM node UNION SELECT e.dst, p.depth + 1 FROM paths p JOIN edge e ON e.src = p.node), deep AS (SELECT node, max(depth) AS depth FROM paths GROUP BY 1) "


@query("dag_depths", _DEPTHS + "SELECT node, depth FROM deep")
def dag_depths(s, d):
    return graph.depths(*V.dag(s, d))


@query("dag_topological", _DEPTHS + "SELECT e.src, e.dst, true AS forward FROM edge e JOIN deep a ON a.node = e.src JOIN deep b ON b.node = e.dst WHERE a.depth < b.depth")
def dag_topological(s, d):
    n, e = V.dag(s, d)
    order = graph.topological_order(n, e)
    a, b = order.select(F.col("node").alias("src"), F.col("depth").alias("x")), order.select(F.col("node").alias("dst"), F.col("depth").alias("y"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", (F.col("x") < F.col("y")).alias("forward"))


@query(
    "dag_critical_path",
    _DEPTHS + ", chain AS (SELECT depth, node FROM deep QUALIFY row_number() OVER (ORDER BY depth DESC, node DESC) = 1 UNION ALL SELECT depth, node FROM (SELECT d.depth, d.node FROM chain c JOIN edge e ON e.dst = c.node JOIN deep d ON d.node = e.src QUALIFY row_number() OVER (ORDER BY d.depth DESC, d.node DESC) = 1)) SELECT depth AS position, node FROM chain",
)
def dag_critical_path(s, d):
    return graph.longest_path(*V.dag(s, d))


#: set hashes in SQL: by prefixes of four and two digits, then all ({k}: the group's keys with a comma behind)
_SETS = "SELECT {k} sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT {k} sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT {k} substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT DISTINCT {k} h FROM {t}) GROUP BY ALL) GROUP BY {k} substr(p, 1, 2)) {g}"
_SETS2 = "SELECT {k}, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT {k}, substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT DISTINCT {k}, h FROM {t}) GROUP BY ALL) GROUP BY {k}"
_F = "coalesce(strlen({0}) || ':' || {0}, '-')"
_NODE = _F.format("node")


def _below(wave: int) -> str:
    """The fingerprints of one wave: its nodes' links to fingerprints of earlier ones."""
    return (
        f", l{wave} AS (SELECT e.dst AS node, m.h FROM edge e JOIN deep d ON d.node = e.dst AND d.depth = {wave} JOIN m{wave - 1} m ON m.node = e.src), b{wave} AS ({_SETS2.format(k='node', t=f'l{wave}')}),"
        f" m{wave} AS (SELECT node, h FROM m{wave - 1} UNION ALL SELECT node, sha256({_NODE} || {_F.format('h')}) FROM b{wave})"
    )


_MERKLE = _DEPTHS + f", m0 AS (SELECT node, sha256({_NODE} || '-') AS h FROM deep WHERE depth = 0)" + _below(1) + _below(2)


@query("dag_node_fingerprints", _MERKLE + " SELECT node, h AS fingerprint FROM m2")
def dag_node_fingerprints(s, d):
    return graph.node_fingerprints(*V.dag(s, d))


@query("dag_fingerprint", _MERKLE + f" SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS edges, h AS fingerprint FROM ({_SETS.format(k='', t='m2', g='')})")
def dag_fingerprint(s, d):
    return graph.fingerprint(*V.dag(s, d))


_PLAN_ROW = "sha256(coalesce(strlen({p}) || ':' || {p}, '-') || {f})"


@query(
    "plan_fingerprints",
    "WITH p AS (SELECT c_custkey AS plan, c_mktsegment AS name FROM customer), a0 AS (SELECT o_custkey AS plan, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR) AS place, o_orderpriority AS axis, o_orderstatus AS value FROM orders),"
    f" a AS (SELECT plan, sha256({_F.format('place')} || {_F.format('axis')} || {_F.format('value')}) AS h FROM a0), b AS (SELECT o_custkey AS plan, sha256('-' || {_F.format('o_orderkey::VARCHAR')} || {_F.format('o_orderstatus')}) AS h FROM orders WHERE o_orderkey % 3 = 0),"
    f" ra AS ({_SETS2.format(k='plan', t='a')}), rb AS ({_SETS2.format(k='plan', t='b')})"
    f" SELECT p.plan, sha256({_F.format('name')} || '4:axes' || {_F.format('ra.h')} || '8:bindings' || {_F.format('rb.h')}) AS fingerprint FROM p LEFT JOIN ra ON ra.plan = p.plan LEFT JOIN rb ON rb.plan = p.plan",
    views=False,
)
def plan_fingerprints(s, d):
    """Every customer a plan: its orders in turn are the axes, every third a binding."""
    o = V.table(s, d, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    axes = o.select(F.col("o_custkey").alias("plan"), place.alias("place"), F.col("o_orderpriority").alias("axis"), F.col("o_orderstatus").alias("value"))
    bindings = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("plan"), F.lit(None).cast("int").alias("place"), F.col("o_orderkey").alias("coordinate"), F.col("o_orderstatus").alias("value"))
    plans = V.table(s, d, "customer").select(F.col("c_custkey").alias("plan"), F.col("c_mktsegment").alias("name"))
    return graph.plan_fingerprints(plans, {"axes": axes, "bindings": bindings})


@query("dag_reduced", "SELECT src, dst FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge f JOIN reach r ON r.src = f.dst AND r.dst = e.dst WHERE f.src = e.src)")
def dag_reduced(s, d):
    return graph.reduction(V.dag(s, d)[1])


@query("dag_broken", "SELECT DISTINCT 'dangling' AS problem, m AS node FROM (SELECT src AS m FROM edge UNION SELECT dst FROM edge) WHERE m NOT IN (SELECT node FROM node WHERE node NOT LIKE 'n%') UNION ALL SELECT 'repeated', node FROM node WHERE node LIKE 'r%'")
def dag_broken(s, d):
    n, e = V.dag(s, d)
    return graph.problems(n.where("node not like 'n%'").unionByName(n.where("node like 'r%'")), e)


_LEVELS = "WITH e AS (SELECT n_nationkey AS pos, 'e' || n_nationkey AS element, n_nationkey % 3 AS axes FROM nation), own AS (SELECT element, CAST(sum(axes) OVER (ORDER BY pos) AS BIGINT) AS own FROM e)"


@query(
    "binding_propagation",
    _LEVELS.replace("WITH e", "WITH RECURSIVE e") + ", l AS (SELECT 'e' || s_nationkey AS src, 'e' || (s_suppkey % 25) AS dst FROM supplier WHERE s_suppkey % 3 <> 2 AND s_nationkey < s_suppkey % 25), r AS (SELECT src, dst FROM l UNION SELECT r.src, l.dst FROM r JOIN l ON l.src = r.dst)"
    " SELECT o.element, o.own, greatest(o.own, coalesce(max(p.own), 0)) AS effective FROM own o LEFT JOIN r ON r.src = o.element LEFT JOIN own p ON p.element = r.dst GROUP BY 1, 2",
    views=False,
)
def binding_propagation(s, d):
    e = V.table(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("e"), "n_nationkey").alias("element"), (F.col("n_nationkey") % 3).cast("long").alias("axes"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "shared").when(F.col("s_suppkey") % 3 == 1, "linear").otherwise("lifeline")
    links = V.table(s, d, "supplier").where("s_nationkey < s_suppkey % 25").select(F.concat(F.lit("e"), "s_nationkey").alias("src"), F.concat(F.lit("e"), F.col("s_suppkey") % 25).alias("dst"), kind.alias("kind"))
    return grid.binding_levels(e, links)


@query("trial_elements_forced", "SELECT DISTINCT 'e' || n_nationkey AS element FROM nation WHERE (n_nationkey NOT IN (SELECT s_nationkey FROM supplier) OR n_nationkey % 5 = 0) AND n_nationkey % 7 <> 3", views=False)
def trial_elements_forced(s, d):
    e = V.table(s, d, "nation").select("n_nationkey", F.concat(F.lit("e"), "n_nationkey").alias("element"))
    links = V.table(s, d, "supplier").select(F.lit("x").alias("src"), F.concat(F.lit("e"), "s_nationkey").alias("dst"), F.lit("shared").alias("kind")).distinct()
    return lifecycle.trial_elements(e.select("element"), links, e.where("n_nationkey % 5 = 0").select("element"), e.where("n_nationkey % 7 = 3").select("element"))


@query("shared_names", "SELECT name, CAST(2 AS BIGINT) AS tiers FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) JOIN (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'BUILDING' ELSE 'OTHER' END AS name FROM orders) USING (name)", views=False)
def shared_names(s, d):
    a = V.table(s, d, "customer").select(F.lit("label").alias("tier"), F.col("c_mktsegment").alias("name"))
    b = V.table(s, d, "orders").select(F.lit("tag").alias("tier"), F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("OTHER").alias("name"))
    return wiring.shared_names(a, b)


# ---- axes, tokens, samples, doubles --------------------------------------------------------------------------------

_TYPES = ("SMALL", "ECONOMY", "PROMO")


@query("axis_index", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 END::BIGINT AS place, p_type IN ('SMALL', 'ECONOMY', 'PROMO') AS held FROM part", views=False)
def axis_index(s, d):
    axis = grid.Axis("part", "type", _TYPES)
    return V.table(s, d, "part").select("p_partkey", axis.index_of(F.col("p_type")).alias("place"), axis.contains(F.col("p_type")).alias("held"))


@query("axes_reordered", "WITH n AS (SELECT (SELECT count(DISTINCT p_type) FROM part) AS s0, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS s1) SELECT i AS trial, '0x' || format('{:x}', i // s0) || format('{:x}', i % s0) AS code FROM (SELECT unnest(range(s0 * s1)) AS i, s0 FROM n)", views=False)
def axes_reordered(s, d):
    axes = [grid.TableAxis.of("part", "type", F.col("p_type"), V.table(s, d, "part")), grid.TableAxis.of("order", "priority", F.col("o_orderpriority"), V.table(s, d, "orders"))]
    return grid.enumerate_tables(s, grid.reordered(axes, [("order", "priority"), ("part", "type")])).select("trial", "code")


@query("token_resolution", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'blue' WHEN 2 THEN NULL ELSE '${x' END AS value FROM part", views=False)
def token_resolution(s, d):
    k = F.col("p_partkey") % 4
    v = V.table(s, d, "part").select("p_partkey", F.when(k == 0, F.col("p_type")).when(k == 1, F.lit("${color}")).when(k == 2, F.lit("${missing}")).otherwise(F.lit("${x")).alias("value"))
    return grid.resolve_tokens(v, s.createDataFrame([("color", "blue")], "key string, text string"))


_ITEMS = "['a', 'b', 'c', 'd', 'e']"


@query("domain_sample_selection", f"SELECT p_partkey, list_transform(list_sort(list_transform({_ITEMS}, lambda v: md5(p_name || ':' || v) || v))[1:CAST(floor((p_size % 10) / 10.0::DOUBLE * 3) AS INTEGER) + 1], lambda x: substr(x, 33)) AS items FROM part", views=False)
def domain_sample_selection(s, d):
    dom = D.Domain("selection", values=("a", "b", "c", "d", "e"), most=3)
    return V.table(s, d, "part").select("p_partkey", dom.sample((F.col("p_size") % 10) / 10.0, F.col("p_name")).alias("items"))


@query("domain_generate", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size ELSE CAST(10 + floor((p_size % 10) / 10.0::DOUBLE * 21) AS BIGINT) END AS value, CASE WHEN p_size % 10 < 5 THEN 10 ELSE 30 END AS edge FROM part", views=False)
def domain_generate(s, d):
    dom, draw = D.Domain("integer", 10, 30), (F.col("p_size") % 10) / 10.0
    return V.table(s, d, "part").select("p_partkey", dom.generate(F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("bigint")), draw).alias("value"), dom.boundary(draw).alias("edge"))


#: a zero of the other sign than q, also where q is infinite, NaN (at least 0) or null (not so); q is bounded rather than
#: replaced by 1 and -1, as Spark takes branches of the constants -0.0 and 0.0 for alike
_ZERO = -(If(Q >= 0.0, Call("min", (Q, lift(1.0))), Call("max", (Q, lift(-1.0)))) * 0.0)


@query("expr_signed_zero", _LINES.format("CASE WHEN q >= 0 THEN '-Infinity'::DOUBLE ELSE 'Infinity'::DOUBLE END AS a, q >= 0 AS c, q >= 0 AS e, true AS f"), views=False)
def expr_signed_zero(s, d):
    unknown = Q < Q  # null where q is, else false
    found = {"a": lift(1.0) / _ZERO, "c": (_ZERO < lift(0.0)) | unknown, "e": (lift(0.0) > _ZERO) | unknown, "f": _ZERO <= lift(0.0)}
    return _lines(s, d).select(*_ID, *[compile_expr(x, SCHEMA).alias(n) for n, x in found.items()])


@query("expr_nan_order", _LINES.format("q = 0 AS a, true AS c, q = 0 AS e"), views=False)
def expr_nan_order(s, d):
    one = Q / Q  # NaN where q is zero, else 1
    found = {"a": one > lift(1e308), "c": one <= one, "e": one > (lift(1.0) / lift(0.0))}
    return _lines(s, d).select(*_ID, *[compile_expr(x, SCHEMA).alias(n) for n, x in found.items()])
