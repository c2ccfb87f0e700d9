"""Percentiles by index against sorted lists."""

import math
import random

import pytest

from paramloom.operators.aggregates import percentile

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("p", [0.0, 0.37, 0.5, 0.99, 1.0])
def test_element_at_index(spark, p):
    rng = random.Random(3)
    groups = {
        "same": [5.0] * 40, "one": [7.5], "spread": [rng.uniform(-1e3, 1e3) for _ in range(3000)], "skewed": [rng.random() for _ in range(2000)] + [1e300], "huge": [-1.7e308, 1.7e308, 0.0],
        "ties": [float(rng.randint(0, 3)) for _ in range(500)], "odd": [NAN, INF, -INF, 1.0, 2.0, NAN], "nan": [NAN, NAN], "inf": [INF, INF, -INF], None: [3.0, 1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["value"] for r in percentile(df, ["k"], "v", p).collect()}
    order = lambda v: (math.isnan(v), v if not math.isnan(v) else 0)
    for k, vs in groups.items():
        want = sorted(vs, key=order)[math.floor(p * (len(vs) - 1))]
        assert got[k] == want or math.isnan(got[k]) and math.isnan(want), k
    want = sorted([v for _, v in rows], key=order)[math.floor(p * (len(rows) - 1))]
    one = percentile(df, [], "v", p).collect()
    assert len(one) == 1 and (one[0]["value"] == want or math.isnan(want))
    assert percentile(df.where("false"), ["k"], "v", p).collect() == []
