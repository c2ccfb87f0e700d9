"""Unequal inclusion probabilities against brute force: certain documents first, the others' probabilities rescaled."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from paramloom.llm import mixing


def _u(i):
    return (int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def _brute(docs, rest):
    """doc_ids of the sample; docs: (id, size, weight) of one source."""
    sure = set()
    while True:
        free = sum(s * w for i, s, w in docs if i not in sure)
        c = (rest - sum(s for i, s, _ in docs if i in sure)) / free if free else 0
        more = {i for i, _, w in docs if i not in sure and c * w >= 1}
        if not more:
            break
        sure |= more
    p = {i: 1.0 if i in sure else c * w for i, _, w in docs}
    assert abs(sum(p[i] * s for i, s, _ in docs) - rest) < 1e-6 * rest
    rank = {i: 1.0 if p[i] <= 0 else _u(i) * (1 - p[i]) / (_u(i) * (1 - p[i]) + (1 - _u(i)) * p[i]) for i, _, _ in docs}
    taken, at = set(), 0
    for i, s, _ in sorted(docs, key=lambda d: (rank[d[0]], d[0])):
        if at < rest and at + s / 2 <= rest:
            taken.add(i)
        at += s
    return taken, sure


def test_weights_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), f"s{i % 2}", float(rng.pareto(1.0) + 0.01), i) for i in range(400)]
    rows += [(1000, "a b c", "s0", None, 1), (1001, "a b", "s1", -1.0, 1), (1002, "a", "s1", float("nan"), 1), (1003, None, "s0", 5.0, 1), (1004, " \n", None, 1.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double, size long")
    out = mixing.mix(docs, weights=(2, 1, 1), share=0.7, weight="w").collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    weight = {i: w if w and w > 0 else 0.0 for i, _, _, w, _ in rows}
    certain = 0
    for source in ("s0", "s1"):
        mine = [(i, len((t or "").split()), weight[i]) for i, t, s, _, _ in rows if s == source]
        total = sum(s for _, s, _ in mine)
        target = got[mine[0][0]]["target"]
        whole = int(target // total)
        taken, sure = _brute([d for d in mine if d[1]], target - whole * total)
        certain += len(sure)
        assert {i for i, s, _ in mine if s and got[i]["copies"] > whole} == taken
        assert sure <= taken
    assert certain > 3 and got[1004]["taken"] == got[1003]["taken"] == 0


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x", "y")] * 3, "doc_id long, text string, source string, target string, copies string")
    assert [r["size"] for r in mixing.mix(docs).collect()] == [2, 2, 2]
    assert mixing.mix(docs.where("false").withColumn("w", F.lit(1.0)), weight="w").count() == 0
