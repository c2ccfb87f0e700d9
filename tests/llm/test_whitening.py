"""Whitening against a plain computation with exact integers and a full eigendecomposition."""

import math

import numpy as np
import pytest

from paramloom.llm import whitening


def rows(n=700, d=12, seed=0):
    rng = np.random.default_rng(seed)
    c = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    return [(i, [float(v) for v in v]) for i, v in enumerate(c)]


def plain(table, components=32):
    kept = [(i, v) for i, v in table if v and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(64 * e) + 1_000_000 for e in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(row[j] for row in x) for j in range(d)]
    deviation = [sum((n * row[j] - s[j]) ** 2 for j in range(d)) for row in x]
    centred = np.array([[(n * row[j] - s[j]) / n for j in range(d)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in kept], n, deviation, e, (centred @ v / np.sqrt(np.maximum(e, 1e-300)))[:, :components]


def result(spark, table, parts=5, **kw):
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(parts)
    model = whitening.fit(df, **kw)
    return df, model, {r["vec_id"]: r for r in whitening.transform(df, model).collect()}


def test_equals_full_decomposition(spark):
    table = rows() + [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [])]
    ids, n, deviation, e, white = plain(table)
    df, model, got = result(spark, table, parts=40)  # two rounds of the tree
    assert model.rows == n and set(got) == set(ids)
    assert [int(got[i]["deviation"]) for i in ids] == deviation
    assert np.allclose(model.eigenvalues, e, rtol=1e-9) and np.allclose(model.explained, e / e.sum(), rtol=1e-9)
    mine = np.array([got[i]["whitened"] for i in ids])
    sign = np.sign((mine * white).sum(0))
    assert np.allclose(mine * sign, white, atol=1e-7)
    assert whitening.identity_error(df, model) < 1e-9


def test_first_components_of_many(spark):
    table = rows(d=40)
    df, model, got = result(spark, table)
    assert {len(r["whitened"]) for r in got.values()} == {32} and whitening.identity_error(df, model) < 1e-9


def test_components_without_variance_are_left_out(spark):
    table = [(i, [v[0], v[1], v[0] + 1.0, 5.0]) for i, v in rows(60)]
    df, model, got = result(spark, table)
    assert len(model.eigenvalues) == 2 and whitening.identity_error(df, model) < 1e-9
    for table in ([(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 9):
        df, model, got = result(spark, table)
        assert model.rows == len(table) and got[1]["whitened"] == [] and int(got[1]["deviation"]) == 0 and whitening.identity_error(df, model) is None


def test_large_numbers_stay_exact(spark):
    table = [(i, [1e9 * i, -3e8 * i * i]) for i in range(50)] + [(99, [1e15, 1e15])]
    table = [(i, [float(np.float32(e)) for e in v]) for i, v in table]
    ids, n, deviation, *_ = plain(table)
    _, model, got = result(spark, table)
    assert [int(got[i]["deviation"]) for i in ids] == deviation and max(deviation) > 1 << 64


def test_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.fit(none) is None and whitening.transform(none, None).collect() == [] and whitening.identity_error(none, None) is None
    clash = spark.createDataFrame([(None, [1.0, 2.0], "x", 1), (7, [2.0, 1.0], None, 2), (7, [2.0, 1.0], "y", 3)], "vec_id long, embedding array<double>, whitened string, n int")
    out = whitening.transform(clash, whitening.fit(clash))
    assert out.columns == ["vec_id", "embedding", "n", "whitened", "deviation"] and out.count() == 3
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30])]):
        with pytest.raises(Exception, match="several lengths|too large"):
            whitening.fit(spark.createDataFrame(bad, "vec_id long, embedding array<double>").coalesce(1))
