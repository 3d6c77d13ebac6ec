"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """A small table, cut off from its lineage: a lost executor costs nothing. Files go when the table does."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As checkpoint, for large tables: compressed Parquet in the shared folder."""
    return _store(df, new_folder(df.sparkSession))


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are written and no longer referred to; it does so when the driver's objects are collected, which a driver with much memory rarely does by itself."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """As written, for tables that nothing reads after the block."""
    base = new_folder(spark)
    n = iter(range(1_000_000))
    try:
        yield lambda df: _store(df, f"{base}/{next(n)}")
    finally:
        remove(spark, base)
