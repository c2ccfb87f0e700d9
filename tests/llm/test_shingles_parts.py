"""Many pairs are verified in parts; all of them are."""

from pyspark.sql import functions as F

from paramloom.llm import scratch, shingles


def test_pairs_in_parts_are_all_verified(spark, monkeypatch):
    rows = [(i, " ".join([*[f"w{k}" for k in range(40 + i % 9)], f"x{i % 5}"])) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = docs.select(F.col("doc_id").alias("a")).join(docs.select(F.col("doc_id").alias("b")), F.col("b") < F.col("a"))
    sets = {i: set(shingles.shingle_set(t, 5).tolist()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if b < a and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    made, write = [], scratch.materialize
    monkeypatch.setattr(shingles, "PART_PAIRS", 20, raising=False)
    monkeypatch.setattr(shingles, "MOST_PARTS", 3, raising=False)
    monkeypatch.setattr(shingles, "materialize", lambda df, label: made.append(label) or write(df, label))
    got = shingles._verified(pairs, docs, 5)
    assert {tuple(r) for r in got.collect()} == want and 20 < len(want) < 276
    assert made.count("links") == 3
