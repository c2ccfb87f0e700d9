"""A training corpus from `documents`: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm import lines, mixing, packing, simhash, toxicity
from paramloom.llm.scratch import few, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives less than one half."""
    bias, weights = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, bias, weights, *docs.columns).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line; n_chars follows the text."""
    kept = lines.line_dedup(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles); documents without words are one group."""
    return simhash.dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows equal in doc_id, source and text share their copies, whichever they are."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keys = ["_id", "_from", "_tie"]
    sizes = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), "_tie")
    taken = materialize(sizes.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("_rows")).where("copies > 0"), "taken")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("_key") == F.col("_tie"))
    keyed = docs.withColumn("_key", text)
    out = keyed.join(taken.where("_rows = 1"), same).select(*COLUMNS, "copies")
    if not few(taken.where("_rows > 1"), 0):
        repeated = keyed.join(taken.where("_rows > 1"), same).groupBy(*keys).agg(F.first(F.struct(*COLUMNS, "copies")).alias("row"))
        out = out.unionByName(repeated.select("row.*"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences that hold each source's share of the mix."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("packing", pack_sequences),
]

#: the classifier and the near-duplicate groups have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
