"""Frequent tokens: lines in parts and both search phases give the links of brute force; words decide, not hashes."""

import numpy as np
from pyspark.sql import functions as F

from paramloom.llm import lines


def _brute(rows):
    gone, seen = {}, []
    for i, text in rows:
        keep = []
        for line in text.split("\n"):
            s = frozenset(line.lower().split())
            if not (s and any(5 * len(s & t) >= 4 * len(s | t) for t in seen)):
                keep.append(line)
            if s:
                seen.append(s)
        gone[i] = "\n".join(keep)
    return gone


def test_hot_tokens_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lines, "FEW", 2)
    monkeypatch.setattr(lines, "SPLIT", 8)
    rng = np.random.default_rng(9)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(40)]
    rows = []
    for i in range(160):
        words = [*rng.permutation(common)[: rng.integers(8, 13)], *rng.choice(rare, rng.integers(0, 3))]
        rows.append((i, " ".join(words) + "\n" + " ".join(rng.choice(rare, 6))))
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_lines_of_colliding_words_stay(spark):
    words = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("w")).withColumn("h", F.hash("w"))
    pairs = words.join(words.groupBy("h").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a <> b"), "h").select("a", "b").distinct().limit(5).collect()
    assert pairs
    rows = [(2 * i + k, f"p{i} q{i} r{i} {w}") for i, r in enumerate(pairs) for k, w in enumerate(r)]
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)
