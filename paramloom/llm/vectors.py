"""Exact metric range join of embeddings by cosine.

Unit vectors with cosine >= c are at most r = sqrt(2 - 2c) apart. Pivots (centres of a bounded sample) partition the
vectors: a vector's home is the cell of its nearest pivot. A pair within r whose homes p < q differ meets in cell p: by
the triangle inequality its vector y of cell q lies within r of p's boundary, (|y-p|^2 - |y-q|^2) / (2 |p-q|) <= r, and
within r of p's ball, |y-p| <= radius(p) + r; only such y are copied to p, and never to cells after their own. So each
pair meets once. Cells join independently, in bounded chunks: a cell's own rows against each other and its copies.
Within a chunk rows are ordered by their distance to the pivot, and only those whose distances differ by r at most are
multiplied. A chunk returns counts of links and a spanning forest of them, never pairs.

Vectors without any structure are all near every boundary (in 64 dimensions pivots are about 1.2 away, r is 0.45 at
0.9): then the bounds exclude little and the products, not the rows moved, grow with the square of the table.

Equal vectors are one row with a multiplicity. Products are taken in single precision to sift; those within a
margin of the threshold are decided in double precision.

Defined cases: null vectors, empty, zero or non-finite ones, and ones with null components link with nothing, nor do
vectors of different dimensions; equal valid vectors link; rows that repeat a vec_id are vectors of their own, whose
null vec_id has a null component unless it links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize

#: vectors of a cell on average, pivots at most, vectors of a chunk; sampled vectors for each pivot
CELL_ROWS, MOST_PIVOTS, CHUNK, SAMPLED = 8192, 1024, 16_384, 8


def reduce_pairs(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n by the pairs."""
    low = np.arange(n)
    while True:
        old = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == old).all():
            return low


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def range_join(vectors: DataFrame, cosine: float = 0.9, cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    base = base.withColumn("v", F.when(good, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 is 0.0
    classes = materialize(base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    # distinct vectors of rows without an id, and ids of several vectors: numbered by the vector
    classes = classes.withColumn("key", F.xxhash64("id", "v"))
    linked, edges = _joined(classes.select("key", "copies", "v"), cosine, cell_rows, chunk)
    component = connected_components(edges).withColumnRenamed("node", "key")
    keyed = materialize(classes.select("key", "id", "copies"), "keys")
    root = component.join(keyed, "key").groupBy("component").agg(F.min("id").alias("low"))
    low = component.join(root, "component").select("key", "low")
    counts = linked.groupBy("key").agg(F.sum("n").alias("n"))
    of = keyed.join(counts, "key", "left").join(low, "key", "left")
    of = materialize(of.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "id").alias("component_id")), "linked")
    ids = classes.select("v", "key")
    table = materialize(ids.join(of, "key").select("v", "n_links", "component_id"), "byvector")
    out = base.join(table, "v", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n unit centres of a bounded sample: its first rows, moved to the means of their cells a few times."""
    p = sample[:n].copy()
    for _ in range(4):
        home = (sample @ p.T).argmax(1)
        sums = np.zeros_like(p)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        p[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9][:, None]
    return p


def _unit(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dimension(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.diff(b.column(column).offsets.to_numpy())
    for d in np.unique(dims):
        yield int(d), b.filter(pa.array(dims == d))


def _joined(classes: DataFrame, cosine: float, cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    n = classes.count()
    pivots = min(MOST_PIVOTS, max(2, n // cell_rows))
    sampled: dict[int, list] = {}
    for row in classes.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(SAMPLED * pivots).collect():  # bounded
        x = np.array(row["v"])
        x = x / np.abs(x).max()
        sampled.setdefault(len(x), []).append(x / np.linalg.norm(x))
    chosen = {d: _centres(np.stack(x), pivots) for d, x in sampled.items()}
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6

    def pivots_of(d: int) -> np.ndarray:
        return chosen.get(d, np.eye(1, d))

    def name(d: int, p: np.ndarray | int):
        return d * MOST_PIVOTS + p

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at home in each cell, and how far the farthest is."""
        for b in batches:
            for d, part in _by_dimension(b, 2):
                far = np.sqrt(np.maximum(2 - 2 * (_unit(part.column(2)) @ pivots_of(d).T), 0))
                home = far.argmin(1)
                cells, at = np.unique(home, return_inverse=True)
                most = np.zeros(len(cells))
                np.maximum.at(most, at, far.min(1))
                yield pa.RecordBatch.from_arrays([pa.array(name(d, cells), pa.int64()), pa.array(np.bincount(at), pa.int64()), pa.array(most)], ["cell", "n", "radius"])

    found = classes.mapInArrow(homes, "cell long, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    own = {r["cell"]: (r["n"], r["radius"]) for r in found.collect()}  # MOST_PIVOTS rows a dimension at most

    def near(d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cells) at which the rows are, their homes among them."""
        p = pivots_of(d)
        square = np.maximum(2 - 2 * (x @ p.T), 0)
        home = square.argmin(1)
        gap = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
        radius = np.array([own.get(name(d, k), (0, -3.0))[1] for k in range(len(p))])
        edge = (square - square[np.arange(len(x)), home][:, None]) <= 2 * reach * gap[home] + 1e-9
        ball = np.sqrt(square) <= radius[None, :] + reach + 1e-9
        before = np.arange(len(p))[None, :] < home[:, None]
        return np.nonzero((edge & ball & before) | (np.arange(len(p))[None, :] == home[:, None])) + (home,)

    def copied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_dimension(b, 2):
                rows, cells, home = near(d, _unit(part.column(2)))
                count = np.bincount(cells[cells != home[rows]], minlength=1)
                at = np.nonzero(count)[0]
                yield pa.RecordBatch.from_arrays([pa.array(name(d, at), pa.int64()), pa.array(count[at], pa.int64())], ["cell", "n"])

    guests = {r["cell"]: r["n"] for r in classes.mapInArrow(copied, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    room = lambda cell: max(16, chunk * 64 // max(64, cell // MOST_PIVOTS))  # noqa: E731 - chunks hold as many numbers in any dimension
    chunks = {c: (-(-h // room(c)), -(-guests.get(c, 0) // room(c))) for c, (h, _) in own.items()}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own rows go to the tasks of their chunk with each chunk of the cell, copies to those of each own chunk."""
        for b in batches:
            for d, part in _by_dimension(b, 2):
                x = _unit(part.column(2))
                rows, cells, home = near(d, x)
                keys = part.column(0).to_numpy()
                mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                take, task, role = [], [], []
                for i, p in zip(rows.tolist(), cells.tolist()):
                    cell = int(name(d, p))
                    ours, others = chunks[cell]
                    if home[i] == p:
                        k = int(mixed[i]) % ours
                        for j in range(ours + others):
                            take.append(i), task.append((cell << 40) + (min(k, j) << 20) + max(k, j)), role.append(0 if j == k else 1 if j > k else 2)
                    else:
                        k = int(mixed[i]) % others
                        for j in range(ours):
                            take.append(i), task.append((cell << 40) + (j << 20) + ours + k), role.append(2)
                take = pa.array(take, pa.int64())
                flat = pa.array(x[take.to_numpy()].reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1) * d, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(role, pa.int8()), part.column(0).take(take), part.column(1).take(take), lists], ["task", "role", "key", "copies", "x"])

    def solve(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        key, copies = table.column("key").to_numpy(), table.column("copies").to_numpy()
        x = _matrix(table.column("x").combine_chunks())
        cell = int(table.column("task")[0].as_py()) >> 40
        far = np.sqrt(np.maximum(2 - 2 * (x @ pivots_of(x.shape[1])[cell - name(x.shape[1], 0)]), 0))
        ranked = np.argsort(far, kind="stable")
        one = bool((role == 0).any())  # a chunk with itself: each pair from its first row
        a = ranked if one else ranked[role[ranked] == 1]
        b = ranked if one else ranked[role[ranked] == 2]
        n = np.zeros(len(key), np.int64)
        single = x.astype(np.float32)
        low = np.arange(len(key))
        for at in range(0, len(a), 256):
            mine = a[at : at + 256]
            start = at if one else int(np.searchsorted(far[b], far[mine[0]] - reach - 1e-9))
            stop = int(np.searchsorted(far[b], far[mine[-1]] + reach + 1e-9, side="right"))
            for f in range(start, stop, 4096):
                theirs = b[f : min(stop, f + 4096)]
                product = single[mine] @ single[theirs].T
                i, j = np.nonzero(product >= cosine - 1e-4)
                if one:
                    i, j = i[f + j > at + i], j[f + j > at + i]
                sure = product[i, j] >= cosine + 1e-4
                i, j, rest = np.append(i[sure], i[~sure]), np.append(j[sure], j[~sure]), int(sure.sum())
                exact = np.einsum("ij,ij->i", x[mine[i[rest:]]], x[theirs[j[rest:]]]) >= cosine
                keep = np.append(np.ones(rest, bool), exact)
                i, j = mine[i[keep]], theirs[j[keep]]
                np.add.at(n, i, copies[j])
                np.add.at(n, j, copies[i])
                low = reduce_pairs(low[i], low[j], len(key))[low] if len(i) else low
        linked, moved = np.nonzero(n)[0], np.nonzero(low != np.arange(len(key)))[0]
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [[pa.array(key[linked]), none(len(moved))], [pa.array(n[linked]), none(len(moved))], [none(len(linked)), pa.array(key[moved])], [none(len(linked)), pa.array(key[low[moved]])]]
        return pa.table(dict(zip(["key", "n", "a", "b"], map(pa.chunked_array, columns))))

    tasks = classes.mapInArrow(deal, "task long, role byte, key long, copies long, x array<double>")
    found = materialize(tasks.groupBy("task").applyInArrow(solve, "key long, n long, a long, b long"), "links")
    return found.where("key is not null").select("key", "n"), found.where("a is not null").select("a", "b")


def op3_embedding_range_join(spark, sf_dir: str) -> DataFrame:
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
