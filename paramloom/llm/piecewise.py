"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes cuts a text's UTF-8 into chunks wherever it meets a trigger of the block size;
each chunk is hashed to one letter. A fingerprint is "block:letters:letters", the second string at twice the
block size. Fingerprints compare by edit distance where their block sizes are equal or differ by a factor of two.

Defined cases: null text is the empty text, whose fingerprint is "1::"; equal texts have equal fingerprints and
likeness 1; a document's successor is the next row by doc_id (nulls first), rows of one doc_id by text, and the
first row follows the last; a lone document follows itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LETTERS_GOAL, LEAST_LETTERS = 7, 64, 32
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: rows of a doc_id range, and the most ranges (their bounds are held by the driver)
RANGE_ROWS, MOST_RANGES = 1000, 20_000

_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.array([pow(0x01000193, j + 1, 1 << 32) for j in range(WINDOW)], np.uint32)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def _letters(prefix: np.ndarray, up: np.ndarray, cuts: np.ndarray) -> str:
    """One letter for each chunk that ends at a cut: its polynomial hash, from prefix sums."""
    ends = prefix[cuts]
    value = (ends - np.concatenate((np.zeros(1, np.uint64), ends[:-1]))) * up[cuts] * _MIX
    return ALPHABET[(value >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """The fingerprint of a whole text's UTF-8."""
    n = len(data)
    if not n:
        return "1::"
    b = np.frombuffer(data, np.uint8)
    wide = np.zeros(n + WINDOW - 1, np.uint32)
    wide[WINDOW - 1 :] = b
    roll = np.zeros(n, np.uint32)
    for j in range(WINDOW):
        roll += wide[WINDOW - 1 - j : n + WINDOW - 1 - j] * _WEIGHTS[j]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    up = _grown("up", _BASE, n)
    prefix = np.cumsum(b * _grown("down", _INVERSE, n), dtype=np.uint64)

    def cuts(block: int) -> np.ndarray:
        found = np.nonzero(roll & np.uint32(block - 1) == 0)[0]
        return found if len(found) and found[-1] == n - 1 else np.append(found, n - 1)

    block = 1 << max(0, (n // LETTERS_GOAL - 1).bit_length() if n > LETTERS_GOAL else 0)
    at = cuts(block)
    while len(at) < LEAST_LETTERS and block > 1:
        block //= 2
        at = cuts(block)
    return f"{block}:{_letters(prefix, up, at)}:{_letters(prefix, up, cuts(2 * block))}"


def distance(a: str, b: str) -> int:
    """Edit distance, a machine-word column at a time (Myers; Python integers hold any length)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for c in b:
        eq = where.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        high = minus | ~(zero | plus) & full
        low = plus & zero
        score += bool(high & top) - bool(low & top)
        high = high << 1 | 1
        plus = (low << 1 | ~(zero | high)) & full
        minus = high & zero & full
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 1.0 - distance(a, b) / max(len(a), len(b), 1)


def likeness(a: str, b: str) -> float:
    """0 to 1; 0 where block sizes differ by more than a factor of two."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(a1, b1), _alike(a2, b2))
    return _alike(a1, b2) if x == 2 * y else _alike(a2, b1) if y == 2 * x else 0.0


def with_successor(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next.

    The texts move once: rows are dealt into ranges of doc_id, and each range's first rows also go to the range
    before, so every row meets its successor in one task, which holds two texts at a time.
    """
    ids = docs.select(F.col("doc_id").cast("long"))
    ranges = min(MOST_RANGES, 1 + ids.count() // RANGE_ROWS)
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [])) if ranges > 1 else []
    edges = np.array(bounds, np.int64)

    def range_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        values = column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return np.searchsorted(edges, values, side="left")

    def lows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for b in batches:
            values = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for r, v in zip(range_of(b.column(0)).tolist(), values.tolist()):
                low[r] = min(low.get(r, v), v)
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array(list(low.values()), pa.int64())], ["r", "low"])

    heads = {x["r"]: x["low"] for x in ids.mapInArrow(lows, "r long, low long").groupBy("r").agg(F.min("low").alias("low")).collect()}
    order = sorted(heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's head closes the last

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows: list[tuple] = []
                for r, i, t in zip(range_of(b.column(0)).tolist(), b.column(0).to_pylist(), b.column(1).to_pylist()):
                    data = (t or "").encode("utf-8", "surrogatepass")
                    row = (i, press.compress(data), fingerprint(data))
                    rows.append((r, 0, *row))
                    if heads[r] == (-(1 << 63) if i is None else i):
                        rows.append((before[r], 1, *row))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int8(), pa.int64(), pa.binary(), pa.string()))], ["r", "tail", "doc_id", "data", "fp"]) if rows else b.slice(0, 0)

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None
        for b in batches:
            out = []
            for r, tail, i, data, fp in zip(*(c.to_pylist() for c in b.columns)):
                text = unpress.decompress(data).decode("utf-8", "surrogatepass")
                if last is not None and last[0] == r:
                    _, _, of, old, old_fp = last
                    cut = len(old) // 4
                    edited = (old[: len(old) - cut] + text[:cut]).encode("utf-8", "surrogatepass")
                    edited_fp = fingerprint(edited)
                    out.append((of, len(old), old_fp, hashlib.sha256(edited).hexdigest(), edited_fp, likeness(old_fp, edited_fp), likeness(old_fp, fp)))
                last = None if tail else (r, tail, i, text, fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(deal, "r long, tail byte, doc_id long, data binary, fp string")
    rows = dealt.repartition(max(1, ranges), "r").sortWithinPartitions("r", "tail", F.col("doc_id").asc_nulls_first(), "data")
    return rows.mapInArrow(pairs, "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double")


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_successor(spark.read.parquet(f"{sf_dir}/documents.parquet"))
