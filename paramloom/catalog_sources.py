"""Queries over external selections, bucketed tables and reachability, with the SQL that states their results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import query
from .operators import graph
from .sources import external, tables
from .sources import views as V
from .sources.shared import new_folder


@query("external_selection", "SELECT s_name AS value, CAST(s_nationkey AS VARCHAR) AS label, s_nationkey IN (3, 4) AS known FROM supplier WHERE s_name > 'Supplier#000000002' AND starts_with(s_name, 'Supplier')", views=False)
def external_selection(s, d):
    """Suppliers as items of an external selection; the bounds reach the resolver, which skips row groups by them."""
    items = external.external(s, "paramloom.sources.external:ParquetItems", ("value", "greater", "Supplier#000000002"), ("value", "starts_with", "Supplier"), path=f"{d}/supplier.parquet", value="s_name", label="s_nationkey")
    return items.select("value", "label", F.col("label").isin("3", "4").alias("known"))


@query("bucketed_join", "SELECT trial_id, status, parameter, value_num FROM results JOIN (SELECT trial_id, parameter, value_num FROM (UNPIVOT wide ON quantity, price, discount INTO NAME parameter VALUE value_num)) USING (trial_id) WHERE attempt > 1")
def bucketed_join(s, d):
    """Results and metrics in tables of their own, joined without an exchange (a test reads the plan)."""
    database = f"pl_{uuid.uuid4().hex}"
    tables.migrate(s, database, new_folder(s, "tables"), buckets=16)
    tables.insert(V.trial_results(s, d), database, "trial_results")
    tables.insert(V.trial_metrics(s, d), database, "trial_metrics")
    joined = tables.join(s.table(f"{database}.trial_results").where("attempt > 1"), s.table(f"{database}.trial_metrics"), "trial_id")
    return joined.select("trial_id", "status", "parameter", "value_num")


#: orders need parts, parts need suppliers; some orders need suppliers as well, which mostly follows from their parts
_NEEDS = (
    "WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber = 1"
    " UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber <= 2) "
)


def _needs(s, d):
    li = V.table(s, d, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    o, p, k = name("o", "l_orderkey"), name("p", "l_partkey"), name("s", "l_suppkey")
    e = li.select(o.alias("src"), p.alias("dst")).unionByName(li.where("l_linenumber = 1").select(p.alias("src"), k.alias("dst")))
    return e.unionByName(li.where("l_linenumber <= 2").select(o.alias("src"), k.alias("dst"))).distinct()


@query("dag_reduction_large", _NEEDS + "SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = e.src AND b.dst = e.dst)", views=False)
def dag_reduction_large(s, d):
    """Edges between orders, parts and suppliers that no chain implies, without the closure of the graph."""
    return graph.reduction(_needs(s, d))


@query("dag_reachable_pairs", _NEEDS + ", pairs AS (SELECT DISTINCT 'o' || o_orderkey AS src, 's' || (1 + o_custkey % (SELECT count(*) FROM supplier)) AS dst FROM orders) SELECT src, dst FROM pairs p WHERE EXISTS (SELECT 1 FROM e WHERE e.src = p.src AND e.dst = p.dst) OR EXISTS (SELECT 1 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = p.src AND b.dst = p.dst)", views=False)
def dag_reachable_pairs(s, d):
    """Which orders lead to a given supplier."""
    many = V.table(s, d, "supplier").count()
    pairs = V.table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), (F.col("o_custkey") % many + 1).cast("string")).alias("dst"))
    return graph.reaches(_needs(s, d), pairs)
