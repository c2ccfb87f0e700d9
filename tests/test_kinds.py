"""Event kinds: stored payloads, the fields a scan reads, odd payloads."""

import pytest
from pyspark.sql import functions as F

from paramloom.streaming import kinds


def test_payloads_are_read_by_field(spark, tmp_path):
    rows = [(i, "step_completed", f"s{i}", i, i / 2) for i in range(50)] + [(50, "execution_paused", None, None, None)]
    df = spark.createDataFrame(rows, "id int, kind string, step_id string, attempt int, duration double")
    df.select("id", "kind", kinds.payload({n: F.col(n) for n in ("step_id", "attempt", "duration")}).alias("payload")).write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    got = kinds.of_kind(stored, "step_completed", "id")
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"s{i}", i, i / 2) for i in range(50)]
    plan = stored.select(kinds.field("duration"))._jdf.queryExecution().executedPlan().toString()
    assert "struct<0:double>" in plan  # the scan reads one field of the payload
    with pytest.raises(ValueError):
        kinds.of_kind(stored, "step_lost")


def test_all_problems_are_told(spark):
    rows = [
        ("step_failed", '{"step_id": "a", "attempt": 1, "error": {"kind": "k", "message": "m"}}', []),
        ("step_failed", '{"step_id": "a", "attempt": "x", "error": {}}', ["missing attempt", "missing error"]),
        ("barrier_reached", None, ["missing barrier_id"]),
        ("barrier_reached", '{"barrier_id": "b", "z": 1, "a": null}', ["unexpected a", "unexpected z"]),
        ("barrier_reached", "3", ["missing barrier_id"]),
        ("nothing", "{}", ["unknown kind"]),
        (None, "{}", ["unknown kind"]),
    ]
    df = spark.createDataFrame([(i, k, p) for i, (k, p, _) in enumerate(rows)], "i int, kind string, p string").withColumn("payload", F.parse_json("p"))
    got = {r["i"]: r["problems"] for r in df.select("i", kinds.problems(F.col("kind")).alias("problems")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(rows)}
    assert set(kinds.wide(df, "i").columns) == {"i", "kind", *kinds.FIELDS} and len(kinds.KINDS) == 15
