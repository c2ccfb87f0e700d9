"""Accessors, checkpoints, diagnostics and axes on small tables with the cases queries do not have."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paramloom.operators import accessors
from paramloom.plans import grid, lifecycle
from paramloom.sources.checkpoints import Checkpoints, Suspensions


def rows(d):
    return sorted((tuple(r) for r in d.collect()), key=str)


def test_checkpoints_and_suspensions(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, k)
    df = lambda *r: spark.createDataFrame(list(r), "execution_id long, checkpoint_id string, created_at timestamp, body string")
    store = Checkpoints(spark, f"file://{tmp_path}/c")
    store.save(df((1, "a", at(1), "x"), (1, "b", at(2), "y"), (2, "c", at(1), "z")))
    store.save(df((1, "a", at(1), "x"), (1, "b", at(2), "new")))  # saved again: the same records
    assert store.get("b").first()["body"] == "new" and store.all().count() == 3
    with pytest.raises(LookupError):
        store.get("q")
    store.delete(df((1, "a", at(1), "")))
    with pytest.raises(LookupError):
        store.get("a")
    store.save(df((1, "d", at(3), "w"), (1, "e", at(3), "v")))
    assert {(r["execution_id"], r["checkpoint_id"]) for r in store.latest().collect()} == {(1, "e"), (2, "c")}
    store.prune(1)
    assert {r["checkpoint_id"] for r in store.all().collect()} == {"e", "c"}
    held = Suspensions(spark, f"file://{tmp_path}/s")
    one = lambda e, b: spark.createDataFrame([(e, at(1), b)], "execution_id long, suspended_at timestamp, body string")
    held.suspend(one(1, "first"))
    held.suspend(one(1, "again"))
    held.suspend(one(2, "x"))
    held.resume(one(2, ""))
    assert [(r["execution_id"], r["body"]) for r in held.all().collect()] == [(1, "again")]


def test_accessors(spark):
    m = spark.createDataFrame([(1, "b", "z", 1.0), (1, "b", "a", 2.0), (1, "a", "q", 3.0), (2, "a", "q", 4.0)], "trial_id long, element string, parameter string, value_num double")
    assert [(r[1], r[2]) for r in accessors.in_order(m).where("trial_id = 1").collect()] == [("a", "q"), ("b", "a"), ("b", "z")]
    assert rows(accessors.get(m, "a", "q").select("trial_id")) == [(1,), (2,)] and accessors.of_element(m, "b").count() == 2
    trials = spark.createDataFrame([(1,), (2,), (3,)], "trial_id long")
    assert rows(accessors.sizes(trials, m)) == [(1, 3, 2, False), (2, 1, 1, False), (3, 0, 0, True)]
    bad = spark.createDataFrame([(1, None, "p", "p"), (1, "e", "p", None), (1, "e", "q", "q"), (1, "e", "q", "q"), (2, "e", "p", "p")], "trial_id long, element string, parameter string, value_parameter string")
    assert [r[3] for r in rows(accessors.assignment_problems(bad))] == ["addressed to another parameter", "assigned twice", "no element"]


def test_resources(spark):
    a = spark.createDataFrame([(1, 2, 3, None, 1, {"gpu": 1}), (1, 1, 1, 1, 1, {"gpu": 2, "tpu": 5}), (None, 1, 1, 1, 1, None)], "pool long, cpu long, memory long, storage long, network long, custom map<string,long>")
    got = {r["pool"]: r for r in accessors.resource_usage(a, "pool").collect()}
    assert (got[1]["active"], got[1]["cpu"], got[1]["storage"], got[1]["custom"]) == (2, 3, 1, {"gpu": 3, "tpu": 5}) and got[None]["custom"] == {}
    assert accessors.resource_usage(a).first()["custom"] == {"gpu": 3, "tpu": 5}


def test_instances_and_diagnostics(spark):
    i = spark.createDataFrame([("a:0", "a", 0), ("b:0", "b", 0), ("b:1", "b", 1)], "instance string, element string, grp int")
    e = spark.createDataFrame([("a:0", "b:0", "shared"), ("a:0", "b:1", "shared")], "src string, dst string, kind string")
    assert rows(accessors.instance_summary(i, e)) == [("a:0", "a", 2, 0, 0), ("b:0", "b", 0, 1, 1), ("b:1", "b", 0, 1, 1)]
    assert accessors.edges_from(e, i.where("grp = 0")).count() == 2 and accessors.edges_to(e, i.where("grp = 1")).count() == 1
    more = e.unionByName(spark.createDataFrame([("b:0", "b:0", "x"), ("q", "b:1", "x")], e.schema))
    assert rows(accessors.instance_problems(i.unionByName(i.limit(1)), more))[0][0] == "dangling" and len(rows(accessors.instance_problems(i.unionByName(i.where("grp = 1")), more))) == 3
    links = spark.createDataFrame([("a", "b", "shared"), ("a", "b", "linear"), ("c", "c", "shared"), ("a", "z", "exclusive"), ("c", "z", "exclusive"), ("z", "a", None)], "src string, dst string, kind string")
    found = {(r[0], r[1], r[2]) for r in lifecycle.diagnostics(spark.createDataFrame([("a",), ("b",), ("c",)], "element string"), links).collect()}
    assert found == {("stated twice", "a", "b"), ("needs itself", "c", "c"), ("undeclared", "a", "z"), ("undeclared", "c", "z"), ("exclusive use by several", "a", "z"), ("exclusive use by several", "c", "z"), ("declared by none", "z", "a"), ("unsupported kind", "z", "a")}


def test_axes_of_tables(spark):
    names = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "n string")
    axis = grid.TableAxis.of("e", "p", F.col("n"), names)
    assert axis.size == 2 and rows(axis.table) == [("a", 0), ("b", 1)] or rows(axis.table.select("place", "value")) == [(0, "a"), (1, "b")]
    none = grid.TableAxis.of("e", "q", F.col("n"), names.where("false"))
    assert grid.enumerate_tables(spark, [axis, none]).collect() == [] and grid.enumerate_tables(spark, []).count() == 1
    got = grid.enumerate_tables(spark, [axis, axis])
    assert rows(got.select("trial", "code", "v0", "v1")) == [(0, "0x00", "a", "a"), (1, "0x01", "a", "b"), (2, "0x10", "b", "a"), (3, "0x11", "b", "b")]
    axes = spark.createDataFrame([("x", "e", "p"), ("x", "e", "q"), ("y", "e", "r")], "axis string, element string, parameter string")
    values = spark.createDataFrame([("x", "integer", 1), ("x", "integer", 2)], "axis string, kind string, value int")
    params = spark.createDataFrame([("e", "p", "integer", False), ("e", "q", "integer", False), ("e", "r", "integer", False)], "element string, parameter string, kind string, derived boolean")
    assert rows(grid.axis_problems(axes, values, values, params, params.where("false"))) == [("x", "name of several axes"), ("y", "no values")]
