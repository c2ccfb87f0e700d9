"""Model views over the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trial_results(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    code = F.concat(F.lit("0x"), F.lower(F.hex(key % 6)), F.lower(F.hex(key % 11)), F.lower(F.hex(key % 5)))
    return table(spark, d, "orders").select(key.alias("trial_id"), F.col("o_custkey").alias("execution_id"), status.alias("status"), (1 + key % 3).cast("int").alias("attempt"), F.col("o_orderdate").alias("started_at"), code.alias("code"))


def assignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("trial_id"), F.lit("order").alias("element"), F.lit("priority").alias("parameter"), F.col("o_orderpriority").alias("value"))


def trial_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id")).agg(F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.min("l_discount").alias("discount"))
    return m.unpivot("trial_id", ["quantity", "price", "discount"], "parameter", "value_num").withColumn("element", F.lit("line"))


def journal(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"signup": "execution_started", "view": "step_started", "click": "step_completed", "error": "step_failed", "purchase": "step_skipped"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("execution_id"), seq.alias("sequence"), "ts", kind.alias("kind"), F.get_json_object("props", "$.k").alias("step_id"), "value", "event_id")


def dag(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    e = n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    e = e.unionByName(s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst")))
    skip = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).where(F.col("s_suppkey") % 3 == 0).select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"))
    e = e.unionByName(skip).distinct()
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e


SQL = """
WITH RECURSIVE results AS (SELECT o_orderkey AS trial_id, o_custkey AS execution_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status,
  CAST(1 + o_orderkey % 3 AS INTEGER) AS attempt, o_orderdate AS started_at, '0x' || format('{:x}', o_orderkey % 6) || format('{:x}', o_orderkey % 11) || format('{:x}', o_orderkey % 5) AS code FROM orders),
assignments AS (SELECT o_orderkey AS trial_id, 'order' AS element, 'priority' AS parameter, o_orderpriority AS value FROM orders),
wide AS (SELECT l_orderkey AS trial_id, sum(l_quantity) AS quantity, max(l_extendedprice) AS price, min(l_discount) AS discount FROM lineitem GROUP BY 1),
journal AS (SELECT user_id AS execution_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence, ts,
  CASE event_type WHEN 'signup' THEN 'execution_started' WHEN 'view' THEN 'step_started' WHEN 'click' THEN 'step_completed' WHEN 'error' THEN 'step_failed' ELSE 'step_skipped' END AS kind,
  json_extract_string(props, '$.k') AS step_id, value, event_id FROM events),
edge AS (SELECT DISTINCT * FROM (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0)),
reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src),
node AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge),
depth AS (SELECT n.node, CASE substr(n.node, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS depth FROM node n)
"""
