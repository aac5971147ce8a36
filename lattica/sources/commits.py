"""Appending JSON lines in batches that can be repeated.

A batch is written to a folder of its own and counts once its commit names that folder; readers
see committed batches only. A batch that was cut off leaves nothing to be seen, one that is
written again finds its commit and adds nothing, and of two writers of one batch the one that
commits first counts. A commit is a small file that is renamed to the batch's name.

    path/_commits/<batch>              {"folder": "<batch>-<attempt>", "rows": n}
    path/<batch>-<attempt>/part-...    lines

Defined cases: a path without commits has no batches; names of batches are letters, digits, dots,
dashes and underscores, and are read in their order; an empty batch counts as one.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_commits"


def file_system_of(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def commits(spark: SparkSession, path: str) -> dict[str, dict]:
    """folder and rows of each committed batch, in the order of names."""
    fs, log = file_system_of(spark, f"{path}/{LOG}")
    if not fs.exists(log):
        return {}
    found = {}
    for status in fs.listStatus(log):
        name = status.getPath().getName()
        if not name.startswith("."):
            found[name] = json.loads(read_small(fs, status.getPath()))
    return dict(sorted(found.items()))


def read_small(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def is_log(spark: SparkSession, path: str) -> bool:
    """Whether batches have been committed to the path."""
    fs, log = file_system_of(spark, f"{path}/{LOG}")
    return fs.exists(log)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Where the lines of committed batches are."""
    return [f"{path}/{c['folder']}" for c in commits(spark, path).values()]


def append_batch(df: DataFrame, path: str, batch: str) -> int:
    """Write a batch of JSON lines; the rows that the batch has. One that is committed already isn't computed."""
    from .records import write_lines

    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"no name of a batch: {batch}")
    spark = df.sparkSession
    if done := commits(spark, path).get(batch):
        return done["rows"]
    attempt = uuid.uuid4().hex
    folder = f"{batch}-{attempt}"
    rows = write_lines(df, f"{path}/{folder}")
    return commit(spark, path, batch, folder, rows)


def commit(spark: SparkSession, path: str, batch: str, folder: str, rows: int) -> int:
    """Make a written folder the batch, unless another one is; the rows of the one that counts."""
    jvm = spark.sparkContext._jvm
    fs, log = file_system_of(spark, f"{path}/{LOG}")
    fs.mkdirs(log)
    draft, name = jvm.org.apache.hadoop.fs.Path(log, f".{folder}"), jvm.org.apache.hadoop.fs.Path(log, batch)
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"folder": folder, "rows": rows}).encode()))
    stream.close()
    if fs.exists(name) or not fs.rename(draft, name):
        fs.delete(draft, False)
    return json.loads(read_small(fs, name))["rows"]


def next_batch(spark: SparkSession, path: str) -> str:
    """A name after all that are committed."""
    return f"{len(commits(spark, path)):08d}"
