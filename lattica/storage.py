"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        here = context._jsc.sc().getCheckpointDir()
        if here.isDefined():
            base = here.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="lattica-")
            context.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/lattica/{context.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local session, as in tests, gets a temporary folder of this machine;
    a cluster is refused, since its executors would each write to a disk of their own.
    """
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store with all that is in it, if it is there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_tables(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; frames that read it can't be used any more."""
    delete_folder(spark, _base(spark))


#: Folders that materialise() has written in a ``scratch`` block.
_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it again.

    It cuts lineage like ``checkpoint()``, but as compressed columns, and a lost executor
    costs nothing that was written before. Within ``scratch``, the folder goes at its end.
    """
    return written(df, name)[0]


def written(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """``materialise``, and the folder that can be deleted."""
    folder = shared_dir(df.sparkSession)
    if _SCRATCH:
        _SCRATCH[-1].append(folder)
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"), folder


@contextmanager
def scratch(spark: SparkSession):
    """Delete what ``materialise`` writes in this block once it ends; what leaves it must have been written outside it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for folder in _SCRATCH.pop():
            delete_folder(spark, folder)


@contextmanager
def unscratched():
    """Within ``scratch``, write for what is around it."""
    inner = _SCRATCH.pop()
    try:
        yield
    finally:
        _SCRATCH.append(inner)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run in this block delete their shuffle files when they end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def file_system(uri: str):
    """pyarrow file system and path of a folder in the shared store."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
