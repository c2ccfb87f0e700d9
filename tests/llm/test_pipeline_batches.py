"""What a Python worker is sent at once while a scratch table is written."""

import pyarrow as pa
from pyspark.sql import functions as F

from paramloom.llm import scratch


def test_python_workers_get_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    before = spark.conf.get(scratch.BATCH_BYTES)
    texts = spark.range(0, 6000, 1, 2).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = scratch.materialize(texts.mapInArrow(sizes, "rows long, bytes long"), "test").collect()
    assert sum(r["rows"] for r in got) == 6000
    assert max(r["bytes"] for r in got) < 3_000_000
    assert spark.conf.get(scratch.BATCH_BYTES) == before
