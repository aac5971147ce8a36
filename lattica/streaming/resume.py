"""Predicting a stream of rows once, over restarts.

Each id has a state: whether it has its output. The state of a new query is seeded with the ids of
the outputs that are there, so neither a restart from the checkpoint nor one without it predicts an
id again. Outputs are appended in committed batches (``sources.commits``) named after the checkpoint
and the micro-batch, so a batch that is run again after a failure adds nothing.

The stream's state is kept in RocksDB (``use_state_store`` sets it for a session).

Defined cases: of rows of one id the first that comes counts; null ids are never held back, as in
``align.pending``; with ``forget_after`` an id's state goes after so many seconds, so that the state
is bounded, and the id counts as new again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import commits
from ..storage import materialise

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _First(StatefulProcessor):
    """The first row of each id that has no output."""

    def __init__(self, forget_after: float | None):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = not self.done.exists()
        for frame in rows:
            if new and len(frame):
                new = False
                self._finish(timerValues)
                yield frame.head(1)

    def _finish(self, timers: Any) -> None:
        self.done.update((True,))
        if self.forget_after is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(1000 * self.forget_after))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._finish(timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.done.clear()
        return iter(())

    def close(self) -> None:
        pass


def pending_stream(rows: DataFrame, done: DataFrame, key: str = "id", forget_after: float | None = None) -> DataFrame:
    """Rows of a stream whose id, a string, has no output yet, and no earlier row."""
    finished = done.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    named = rows.where(F.col(key).isNotNull()).groupBy(key)
    first = named.transformWithStateInPandas(_First(forget_after), rows.schema, "append", "none" if forget_after is None else "processingTime", finished.groupBy(key))
    return first.unionByName(rows.where(F.col(key).isNull()))


def _name(spark: SparkSession, checkpoint: str) -> str:
    """A name that a checkpoint keeps."""
    fs, path = commits.file_system_of(spark, f"{checkpoint}/outputs-name")
    if not fs.exists(path):
        stream = fs.create(path, False)
        stream.write(bytearray(uuid.uuid4().hex.encode()))
        stream.close()
    return commits.read_small(fs, path)


def predict_stream(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, key: str = "id", forget_after: float | None = None) -> StreamingQuery:
    """Append to ``path`` what ``predict`` makes of rows that it doesn't have; the query ends when the source is read."""
    from ..sources.records import read_records

    spark = rows.sparkSession
    has = commits.is_log(spark, path) and bool(commits.folders(spark, path))
    outputs = read_records(spark, path).select(F.get_json_object("raw", f"$.{key}").alias(key)) if has else spark.range(0).select(F.lit("").alias(key))
    outputs = materialise(outputs, "ids")  # a table: a stream's plan takes no numbering of rows
    name = _name(spark, checkpoint)

    def append(batch: DataFrame, number: int) -> None:
        commits.append_batch(predict(batch), path, f"{name}-{number:012d}")

    todo = pending_stream(rows, outputs, key, forget_after)
    return todo.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
