"""Helpers that several training-data operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import delete_folder, file_system, materialise, scratch, shared_dir, shuffles_removed, unscratched, written  # the operators take them from here

#: A word is a run of anything but ASCII blanks (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ranked(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Number rows of equal keys from 0 in ``_rank``, in 1024 chunks of each key; rows must have been written, so that they don't change places."""
    rows = rows.withColumn("_chunk", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    before = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_base", F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(by)))
    same = [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)]
    before = before.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)), F.col("_chunk").alias("_bchunk"), "_base")
    joined = rows.join(before, [*same, F.col("_chunk") == F.col("_bchunk")])
    return joined.withColumn("_rank", F.col("_base") + F.col("_rank") - 1).drop("_base", "_chunk", "_bchunk", *(f"_b{i}" for i in range(len(keys))))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded table out of driver values that needs neither RDD nor Python worker."""
    text = json.dumps(rows)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
