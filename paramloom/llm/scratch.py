"""Shared scratch space: written tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Spark's own setting: an execution's shuffle files go with its end, not when the driver next collects its garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: bytes of rows that go to a Python worker at once (Spark's default is 64 MB): executor and worker both hold each batch, and grow it by doubling
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_WRITING = {SHUFFLE_CLEANUP: "true", BATCH_BYTES: "2m"}
_tables: weakref.WeakKeyDictionary[DataFrame, tuple[SparkSession, str]] = weakref.WeakKeyDictionary()


def root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only on a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if named is None and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
    return (named or f"file://{tempfile.gettempdir()}/checkpoints/paramloom").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{root(spark)}/paramloom-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder (with the writer's options) and read it back: later stages restart from the files.

    The shuffle files of the write are of no use after it and are deleted with its end; Python workers get small batches."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = {key: spark.conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        df.write.options(**options).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = (spark, path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() gave, once everything made from them is itself materialized.

    What was broadcast for them stays in the driver until it collects its garbage; once half of its heap is taken it is asked to."""
    for table in tables:
        entry = _tables.pop(table)
        _written.remove(entry)
        _delete(*entry)
    if tables:
        jvm = entry[0].sparkContext._jvm
        heap = jvm.java.lang.Runtime.getRuntime()
        if 2 * heap.totalMemory() > heap.maxMemory():
            jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_all() -> None:
    """Delete every table written by this process (at exit; callable earlier once results are stored)."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def _at_exit() -> None:
    try:
        release_all()
    except Exception:  # noqa: BLE001 - the JVM may already be gone
        pass


atexit.register(_at_exit)


def few(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows, found without counting further than that."""
    return df.limit(limit + 1).count() <= limit
