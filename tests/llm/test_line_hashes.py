"""Lines whose words share a 32-bit hash are not equal."""

from pyspark.sql import functions as F

from paramloom.llm import lines


def test_words_of_equal_short_hash_stay(spark):
    # 200,000 keys: about five pairs of them share Spark's 32-bit hash
    words = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("w")).withColumn("h", F.hash("w"))
    clash = sorted(r["w"] for r in words.join(words.groupBy("h").count().where("count > 1"), "h").collect())
    assert clash
    rows = [(i, w) for i, w in enumerate(clash)]
    # and within the join: lines of four words and more that differ in one word of equal hash
    pairs = words.join(words.groupBy("h").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a <> b"), "h").select("a", "b").distinct().collect()
    rows += [(10_000 + 2 * i + k, " ".join([f"p{i}", f"q{i}", f"r{i}", w])) for i, r in enumerate(pairs) for k, w in enumerate(r)]
    docs = spark.createDataFrame([*rows, (99_999, f"{clash[0].upper()}\nlast")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(docs).collect()}
    assert {i: got[i] for i, _ in rows} == dict(rows)
    assert got[99_999] == "last"
