"""Embedding whitening by a tall-skinny QR.

Vectors become integers x = floor(SCALE * c) + SHIFT, whose sums S over all rows are exact. Rows are centred as
(n * x - S) / n: the numerator is an exact integer, so the large shift costs no precision. Each task folds its rows
block by block into one triangular factor R; factors are merged in a tree of joint QRs until one is left, whose singular
values and right vectors are those of all centred rows. No covariance of x is ever formed. A component is whitened by
its eigenvalue e = s^2 / n.

The driver holds what is as long as a vector or as wide as a vector squared, never rows: the sums, the last factor, the
directions. Tasks hold a block of rows and one factor; a tree node holds FAN factors.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are left out; vectors of several
lengths are refused, as are entries whose x is no 64-bit integer (ValueError); repeated rows count each; components
without variance (constant dimensions, fewer rows than dimensions) are left out, so one row alone, or equal rows, give
none; an empty table gives no rows; columns of the input stay, except those named `deviation` or `whitened`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, materialize

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: rows that are folded into R together, and factors that one tree node merges
BLOCK, FAN = 4096, 16


@dataclass(frozen=True)
class Whitening:
    """Rows of the fit list, exact sums, and per component (by falling eigenvalue) its direction, eigenvalue and share."""

    rows: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an array column remain, and their integers x (rows x length)."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    value = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(column), bool)
    bad[np.repeat(np.arange(len(column)), sizes)[~np.isfinite(value)]] = True
    keep = (sizes > 0) & ~bad
    lengths = np.unique(sizes[keep])
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths.tolist()}")
    value = np.floor(value[np.repeat(keep, sizes)] * SCALE)
    if np.abs(value).max(initial=0) >= 2.0**62:
        raise ValueError("an entry is too large for a 64-bit integer")
    return np.nonzero(keep)[0], (value.astype(np.int64) + SHIFT).reshape(len(np.nonzero(keep)[0]), int(lengths[0]) if len(lengths) else 0)


def _offsets(x: np.ndarray, rows: int, sums: tuple[int, ...]) -> np.ndarray:
    """rows * x - S, exact: 64-bit where it fits, else Python's integers."""
    largest = rows * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if largest < 1 << 62:
        return rows * x - np.array(sums, np.int64)
    return rows * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, rows: int, sums: tuple[int, ...]) -> np.ndarray:
    return (_offsets(x, rows, sums) / rows).astype(np.float64)


def _squares(y: np.ndarray) -> list[Decimal]:
    """The sum of each row's squares, exact."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 1 << 63:
        return [Decimal(v) for v in (y * y).sum(1).tolist()]
    return [Decimal(sum(int(v) * int(v) for v in row)) for row in y]


def _sums(vectors: DataFrame) -> DataFrame:
    """(length, i, n, s): per task and dimension the rows and the sum of x."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            _, x = _vectors(batch.column(0))
            if not len(x):
                continue
            if total is not None and len(total) != x.shape[1]:
                raise ValueError(f"vectors of several lengths: {sorted((len(total), x.shape[1]))}")
            part = x.astype(object) if int(np.abs(x).max()) * (n + len(x)) >= 1 << 62 else x
            n, total = n + len(x), part.sum(0) + (0 if total is None else total)
        if n:
            d = len(total)
            sums = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), sums], names=["length", "i", "n", "s"])

    return vectors.mapInArrow(run, "length int, i int, n long, s decimal(38,0)")


def _tree(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value from (id, value): neighbours are merged FAN at a time, each round written to the shared folder."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        return pd.DataFrame({"id": [int(group["id"].iloc[0])], "value": [merge([bytes(v) for v in group["value"]])]})

    table = materialize(parts, "parts")
    while True:
        last = table.agg(F.max("id")).first()[0]
        if not last:
            break
        up = table.withColumn("id", F.floor(F.col("id") / FAN)).groupBy("id").applyInPandas(run, "id long, value binary")
        table, below = materialize(up, "parts"), table
        discard(below)
    row = table.first()
    discard(table)
    return None if row is None else bytes(row["value"])


def _joint_r(factors: list[bytes]) -> bytes:
    """The triangular factor of factors one below another."""
    d = int(np.sqrt(len(factors[0]) // 8))
    return _r(np.concatenate([np.frombuffer(f, np.float64).reshape(-1, d) for f in factors])).tobytes()


def _r(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of rows (padded with zeros below when there are fewer rows than columns)."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == r.shape[1] else np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def _factors(vectors: DataFrame, rows: int, sums: tuple[int, ...]) -> DataFrame:
    """(id, value): the factor of each task's centred rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(sums)))
        for batch in batches:
            _, x = _vectors(batch.column(0))
            for at in range(0, len(x), BLOCK):
                r = _r(np.concatenate([r, _centred(x[at : at + BLOCK], rows, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["id", "value"])

    return vectors.mapInArrow(run, "id long, value binary")


def fit(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all remaining vectors; None if there are none."""
    vectors = table.select(F.col(f"`{vector}`"))
    found = _sums(vectors).groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("length", "i").collect()
    if not found:
        return None
    lengths = sorted({r["length"] for r in found})
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths}")
    rows, sums = int(found[0]["n"]), tuple(int(r["s"]) for r in found)
    d = len(sums)
    r = np.frombuffer(_tree(_factors(vectors, rows, sums), _joint_r), np.float64).reshape(d, d)
    _, s, right = np.linalg.svd(r)
    k = min(components, int((s > s[0] * d * np.finfo(float).eps).sum()))
    e = s * s / rows
    return Whitening(rows, sums, right[:k].T.copy(), e[:k], e[:k] / e.sum() if k else e[:0])


def transform(table: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The remaining rows with `whitened` (array of doubles by component) and `deviation` (sum over dimensions of
    (n * x - S)^2, an exact decimal; beyond 38 digits an error)."""
    kept = table.select(*[F.col(f"`{c}`") for c in table.columns if c not in ("whitened", "deviation")])
    place = kept.columns.index(vector)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _vectors(batch.column(place))
            for low in range(0, len(x), BLOCK):
                y = _offsets(x[low : low + BLOCK], model.rows, model.sums)
                white = (y / model.rows).astype(np.float64) @ model.directions / np.sqrt(model.eigenvalues)
                ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
                new = [pa.ListArray.from_arrays(ends, pa.array(white.ravel())), pa.array(_squares(y), pa.decimal128(38, 0))]
                part = batch.take(pa.array(at[low : low + BLOCK]))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "whitened", "deviation"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", whitened array<double>, deviation decimal(38,0)"
    if model is None:
        return kept.where("false").selectExpr("*", "CAST(NULL AS array<double>) AS whitened", "CAST(NULL AS decimal(38,0)) AS deviation")
    return kept.mapInArrow(run, schema)


def _moments(white: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = white.mean(0)
    return len(white), mean, (white - mean).T @ (white - mean)


def _added(a: tuple, b: tuple) -> tuple:
    """Rows, means and centred products of two sets of rows together."""
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _packed(m: tuple) -> bytes:
    return np.concatenate([[float(m[0])], m[1], m[2].ravel()]).tobytes()


def _joint_moments(values: list[bytes]) -> bytes:
    total = None
    for v in values:
        flat = np.frombuffer(v, np.float64)
        k = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
        one = (flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k))
        total = one if total is None else _added(total, one)
    return _packed(total)


def identity_error(table: DataFrame, model: Whitening | None, vector: str = "embedding") -> float | None:
    """The largest absolute entry of (covariance of the whitened rows - identity), measured on the rows themselves."""
    if model is None or not len(model.eigenvalues):
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = _vectors(batch.column(0))
            for low in range(0, len(x), BLOCK):
                one = _moments(_centred(x[low : low + BLOCK], model.rows, model.sums) @ model.directions / np.sqrt(model.eigenvalues))
                total = one if total is None else _added(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(total)], pa.binary())], names=["id", "value"])

    flat = np.frombuffer(_tree(table.select(F.col(f"`{vector}`")).mapInArrow(run, "id long, value binary"), _joint_moments), np.float64)
    k = len(model.eigenvalues)
    return float(np.abs(flat[k + 1 :].reshape(k, k) / flat[0] - np.eye(k)).max())


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector and component. `deviation` is a long there: a sum beyond 64 bits is an error, not a wrong number."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(table)
    error = identity_error(table, model)
    rows = transform(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    shares = [float(v) for v in model.explained] if model is not None else []
    explained = F.get(F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>"), F.col("_k"))
    return rows.select(
        "vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(model.rows if model else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
