"""Row-level operators over a stream of responses.

Parsing, error tags and rewards are stateless, so they run on a stream as on a table; only
duplicates need state, which a watermark bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import parse_response
from ..functions.scoring import error_tags, score_response
from ..types import TARGET

RESPONSE = T.StructType([T.StructField("id", T.StringType()), T.StructField("response", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("target", TARGET)])


def read_responses(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def score_stream(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First response of each id within the delay, with its errors and reward."""
    once = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    parsed = once.withColumn("parsed", parse_response(F.col("response")))
    target = F.col("target")
    return parsed.withColumns({"errors": error_tags(target, F.col("parsed")), "reward": score_response(target, F.col("parsed"), F.lit(1.0))["reward"]})


def error_windows(scored: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Counts of error tags by window of event time."""
    return scored.select("ts", F.explode("errors").alias("tag")).groupBy(F.window("ts", window), "tag").agg(F.count(F.lit(1)).alias("n"))


def write_batches(scored: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch to ``sink`` once; it ends when the folder is read."""
    return scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
