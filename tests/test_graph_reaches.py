"""Reachability and reduction against a plain search, on graphs of few and of many waves and with hubs."""

import random

import pytest

from paramloom.operators import graph


def _search(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    far = {}

    def go(a):
        if a not in far:
            far[a] = set()
            for b in after.get(a, ()):
                far[a] |= {b} | go(b)
        return far[a]

    for a, _ in edges:
        go(a)
    return after, far


def _random(seed, n, m, reach):
    rng = random.Random(seed)
    found = set()
    while len(found) < m:
        a = rng.randint(0, n - 2)
        found.add((f"n{a:03d}", f"n{rng.randint(a + 1, min(n - 1, a + reach)):03d}"))
    return sorted(found)


HUB = sorted({("r", f"n{i}") for i in range(5)} | {(f"n{i % 5}", f"s{i}") for i in range(60)} | {("r", f"s{i}") for i in range(0, 60, 3)} | {("q", "s1"), ("q", "n3"), ("q", "s3")})


@pytest.mark.parametrize("edges", [HUB, _random(1, 30, 70, 8), _random(2, 40, 60, 4)], ids=["hub", "dense", "deep"])
def test_reaches_and_reduction(spark, edges):
    after, far = _search(edges)
    nodes = sorted({x for e in edges for x in e})
    rng = random.Random(5)
    pairs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)})
    e = spark.createDataFrame(edges, "src string, dst string").repartition(2)
    p = spark.createDataFrame(pairs + pairs[:9], "src string, dst string")
    got = [tuple(r) for r in graph.reaches(e, p).collect()]
    assert sorted(got) == [(a, b) for a, b in pairs if b in far.get(a, ())]
    implied = {(a, b) for a, b in edges if any(b in far.get(c, ()) for c in after[a])}
    assert sorted(tuple(r) for r in graph.reduction(e).collect()) == sorted(set(edges) - implied)


def test_search_rows_grow_with_the_pairs(spark, monkeypatch):
    """Pairs from one hub to many leaves: a search that goes forward sees hub's leaves once a pair."""
    n = 400
    edges = [("r", f"n{i % 4}") for i in range(4)] + [(f"n{i % 4}", f"s{i}") for i in range(n)] + [("r", f"s{i}") for i in range(n)]
    seen, real = [], graph.written

    def counted(df, label):
        table = real(df, label)
        seen.append(table.count())
        return table

    monkeypatch.setattr(graph, "written", counted)
    left = graph.reduction(spark.createDataFrame(edges, "src string, dst string")).count()
    assert left == 4 + n
    assert max(seen) <= 3 * n


def test_cycles_are_told(spark):
    with pytest.raises(ValueError, match="cycle"):
        graph.reduction(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string"))
