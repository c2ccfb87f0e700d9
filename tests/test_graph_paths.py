"""Longest paths and fingerprints of graphs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from paramloom.operators import graph


def frames(spark, edges, more=()):
    names = sorted({x for e in edges for x in e} | set(more))
    return spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(edges, "src string, dst string") if edges else spark.createDataFrame([], "src string, dst string")


def plain_path(edges, names):
    before = {n: {a for a, b in edges if b == n} for n in names}
    deep = {}

    def depth(n):
        if n not in deep:
            deep[n] = max((depth(a) + 1 for a in before[n]), default=0)
        return deep[n]

    at = max(names, key=lambda n: (depth(n), n))
    path = [at]
    while before[at]:
        at = max(before[at], key=lambda n: (depth(n), n))
        path.append(at)
    return deep, path[::-1]


@pytest.mark.parametrize("seed", range(3))
def test_longest_path_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 30
    edges = sorted({(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(45)) if a < b})
    nodes, e = frames(spark, edges, ["lone"])
    deep, path = plain_path(edges, [r["node"] for r in nodes.collect()])
    assert {r["node"]: r["depth"] for r in graph.depths(nodes, e).collect()} == deep
    assert sorted(tuple(r) for r in graph.longest_path(nodes, e).collect()) == list(enumerate(path))


def test_long_chain_and_empty_graphs(spark):
    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(22)]
    nodes, e = frames(spark, edges)
    assert graph.critical_path(nodes, e) == [f"{k:03}" for k in range(23)]
    nodes, e = frames(spark, [], ["a", "b"])
    assert graph.critical_path(nodes, e) == ["b"]
    nodes, e = frames(spark, [])
    assert graph.critical_path(nodes, e) == [] and graph.depths(nodes, e).collect() == []


def root(spark, edges, more=(), parts=1):
    nodes, e = frames(spark, edges, more)
    return graph.fingerprint(nodes.repartition(parts), e.repartition(parts)).first()["fingerprint"]


def test_fingerprints_tell_every_edge_and_no_order(spark):
    edges = [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")]
    base = root(spark, edges)
    assert root(spark, edges[::-1] + edges[:1], parts=3) == base
    others = [root(spark, edges[:-1]), root(spark, [*edges[:-1], ("b", "c")]), root(spark, [*edges, ("a", "d")]), root(spark, edges, ["e"])]
    assert len({base, *others}) == 5
    assert root(spark, [("a|b", "c")]) != root(spark, [("a", "b|c")])


def test_equal_subgraphs_have_equal_fingerprints(spark):
    nodes = spark.createDataFrame([(n, n[-1]) for n in ("x1a", "x2a", "y1b", "y2b", "y3b")], "node string, kind string")
    e = spark.createDataFrame([("x1a", "y1b"), ("x2a", "y2b"), ("x1a", "y3b"), ("x2a", "y3b")], "src string, dst string")
    got = {r["node"]: r["fingerprint"] for r in graph.node_fingerprints(nodes, e, "kind").collect()}
    # two ancestors that are alike count once: a set of subgraphs
    assert got["x1a"] == got["x2a"] and got["y1b"] == got["y2b"] == got["y3b"] and got["x1a"] != got["y1b"]
    got = {r["node"]: r["fingerprint"] for r in graph.node_fingerprints(nodes, e).collect()}
    assert len(set(got.values())) == 5


def test_plan_fingerprints_tell_places_nulls_and_parts(spark):
    plans = spark.createDataFrame([(k, "p", None) for k in range(8)], "plan int, name string, policy string")
    axes = [(0, 1, "a", "x"), (0, 2, "b", "y"), (1, 2, "b", "y"), (1, 1, "a", "x"), (2, 2, "a", "x"), (2, 1, "b", "y"), (3, 1, "a", None), (4, 1, "a", ""), (5, 1, "ab", "c"), (6, 1, "a", "bc")]
    axes = spark.createDataFrame(axes, "plan int, place int, axis string, value string")
    bind = spark.createDataFrame([(0, None, "q"), (1, None, "q"), (7, None, "q")], "plan int, place int, key string")
    got = {r["plan"]: r["fingerprint"] for r in graph.plan_fingerprints(plans, {"axes": axes, "bindings": bind}).collect()}
    assert got[0] == got[1] and len(set(got.values())) == 7
    other = plans.withColumn("policy", F.lit("none"))
    assert not {r["fingerprint"] for r in graph.plan_fingerprints(other, {"axes": axes, "bindings": bind}).collect()} & set(got.values())
