"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only on a local master, as in tests."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_base(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Cuts the lineage of tables: they are computed now and kept in the shared folder as long as they are used."""
    shared_base(spark)
    return lambda df: df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder; none where it doesn't exist."""
    system, place = file_system(spark, path)
    return {f.getPath().getName() for f in system.listStatus(place)} if system.exists(place) else set()


def remove(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)
