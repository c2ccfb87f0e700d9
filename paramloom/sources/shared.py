"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only on a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if named is None and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
    return (named or f"file://{tempfile.gettempdir()}/checkpoints/paramloom").rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own; what is written there goes when this process ends."""
    path = f"{root(spark)}/paramloom-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(Hadoop path, its file system)"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in a shared folder, read back: later work starts from the files."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() from which nothing more is read."""
    for table in tables:
        path = _tables.pop(table)
        _made.remove((table.sparkSession, path))
        delete(table.sparkSession, path)


def _at_exit() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may already be gone
            return


atexit.register(_at_exit)
