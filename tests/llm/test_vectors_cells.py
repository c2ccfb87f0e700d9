"""The range join over many cells and chunks against brute force; empty tables and clashing columns."""

import numpy as np
import pytest

from paramloom.llm import vectors


def _brute(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    low = np.arange(len(x))
    while True:
        new = np.array([low[row].min() for row in link])
        if (new == low).all():
            return link.sum(1) - 1, low
        low = new


@pytest.mark.parametrize("dims, cell_rows, chunk", [(8, 40, 16), (8, 25, 400), (16, 8192, 16384)])
def test_clusters_over_cells_and_chunks(spark, dims, cell_rows, chunk):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(100, dims))
    x = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), base + 0.3 * rng.normal(size=base.shape), base[:5], np.repeat(base[:1], 40, axis=0) + 0.01 * rng.normal(size=(40, dims))])
    n, low = _brute(x)
    assert n.sum() > 1000
    rows = [(i, v.tolist(), 0, 1, 2, "c", True) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int, copies int, id int, cell string, kept boolean")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.range_join(table, 0.9, cell_rows, chunk).collect()}
    assert got == {i: (n[i], low[i], low[i] == i) for i in range(len(x))}


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = vectors.range_join(table)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0
    none = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in vectors.range_join(none).collect()) == [(0, 0, 0, True), (1, 0, 1, True)]
