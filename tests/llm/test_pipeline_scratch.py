"""What the pipeline's stages leave behind: shuffle files, scratch tables, lists of numbers on the driver."""

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paramloom.llm import scratch, shingles, toxicity


def _shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{at}/{x}" for d in dirs for at, _, names in os.walk(d.getPath()) for x in names if x.startswith("shuffle_")}


def _left(since):
    return sorted({path.rsplit("/", 1)[1].split("-")[1] for _, path in scratch._written[since:]})


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = _shuffled(spark), spark.conf.get(scratch.SHUFFLE_CLEANUP)
    table = scratch.materialize(spark.range(5000).withColumn("k", F.xxhash64("id")).repartition("k"), "test")
    for _ in range(100):  # they go in the background
        if not (left := _shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 5000
    assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == setting


def test_near_dedup_keeps_small_tables_only(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: 50 + i % 3], f"x{i % 5}"])) for i in range(30)] + [(100 + i, f"own words of the text {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    since = len(scratch._written)
    once = {tuple(r) for r in shingles.near_copies(docs).collect()}
    assert not {"prefixes", "ours", "postings", "heads", "shared", "rest", "sets", "edges"} & set(_left(since))
    twice = {tuple(r) for r in shingles.near_copies(docs.unionByName(docs).repartition(5)).collect()}
    assert once == twice and len({c for _, c in once}) == 10


def test_classifier_leaves_no_tables(spark):
    rows = [(i, ("you pathetic idiot " if i % 3 == 0 else "a kind and quiet text ") + f"number {i}", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    since = len(scratch._written)
    toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert _left(since) == []


def test_design_is_in_the_order_of_lists():
    rng = np.random.default_rng(5)
    lists = [sorted(rng.choice(70_000, int(rng.integers(0, 6)), False).tolist()) for _ in range(200)] + [[], [1], [1, 256], [256], [256]]
    soft = [round(float(x), 1) for x in rng.random(len(lists))]
    want = sorted((tuple(h), s) for h, s in zip(lists, soft))
    table = pa.table({"hits": pa.chunked_array([pa.array(lists[:90], pa.list_(pa.int32())), pa.array(lists[90:], pa.list_(pa.int32()))]), "soft": soft})
    rows, columns, got = toxicity._design(table)
    assert got.tolist() == [s for _, s in want]
    assert columns.tolist() == [x for h, _ in want for x in h]
    assert rows.tolist() == [i for i, (h, _) in enumerate(want) for _ in h]
