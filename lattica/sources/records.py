"""Record files: JSON lines or one JSON array in, compact JSON lines out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .arrays import read_array
from .commits import folders, is_log


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ord and raw of each line that isn't blank, numbered in file order.

    Numbers come from counts by input block, so no task sees the whole file.
    """
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    lines = lines.where(F.trim("raw") != "")
    before = W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))  # a row for each block
    base = counts.select(F.col("_f").alias("_f2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = lines.withColumn("_r", F.row_number().over(W.partitionBy("_f", "_b").orderBy("_m")) - 1)
    on = (F.col("_f") == F.col("_f2")) & (F.col("_b") == F.col("_b2"))
    return local.join(base, on).select((F.col("_base") + F.col("_r")).alias("ord"), "raw")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """By the first character: ``[`` is an array, anything else JSON lines. Of a path with a commit log, the committed lines.

    Records that are no objects raise when read.
    """
    if is_log(spark, path):
        return _objects(read_lines(spark, folders(spark, path)))
    # what comes before the first quote: an array may be one line of any length
    first = spark.read.option("lineSep", '"').text(path).select(F.substring(F.trim(F.regexp_replace("value", r"\s", "")), 1, 1)).limit(1).collect()
    rows = read_array(spark, path) if first and first[0][0] == "[" else read_lines(spark, path)
    return _objects(rows)


def _objects(rows: DataFrame) -> DataFrame:
    bad = F.coalesce(F.json_object_keys("raw").isNull(), F.lit(True))
    return rows.withColumn("raw", F.when(bad, F.raise_error(F.lit("a record is no JSON object")).cast("string")).otherwise(F.col("raw")))


def parse_records(rows: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Typed fields of raw records, with ord."""
    return rows.select("ord", F.from_json("raw", schema).alias("_r")).select("ord", "_r.*")


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """All of a folder's split files, with their split."""
    return union([read_records(spark, f"{folder}/{s}.json").withColumn("split", F.lit(s)) for s in splits])


def union(parts: list[DataFrame]) -> DataFrame:
    """Shards as one table."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def json_lines(df: DataFrame) -> DataFrame:
    """One compact JSON text per row, in column order, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str, *, append: bool = False) -> int:
    """Write JSON lines; how many. The count is observed while writing, not counted again."""
    from pyspark.sql import Observation

    seen = Observation()
    json_lines(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").text(path)
    return seen.get["n"]
