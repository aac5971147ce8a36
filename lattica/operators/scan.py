"""Sums over an order, and ranks, in as many tasks as the data asks for.

Rows are dealt to ranges of the order, about ``PART_ROWS`` rows each, and written with their
range's number. The ranges' totals, one row for each range and group, are summed up in order,
and each range adds what lies before it to its own running sums. So no task ever sees more
than a range, and the number of ranges follows the data.

Rows that are equal in the whole order stay in one range: callers sum them up first, or add a
column that tells them apart. Null group keys are a group; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialise

#: Rows of a range.
PART_ROWS = 1 << 18
RANGE = "_range"


def range_count(rows: int, part_rows: int = PART_ROWS) -> int:
    return max(1, math.ceil(rows / part_rows))


def in_ranges(df: DataFrame, order: list[Column], part_rows: int = PART_ROWS) -> DataFrame:
    """The rows, written, with ``_range``: numbers of consecutive ranges of the order. df should be cheap to read twice."""
    ranges = df.repartitionByRange(range_count(df.count(), part_rows), *order)
    return materialise(ranges.withColumn(RANGE, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, by: list[str], order: list[Column], values: list[str], *, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``<value>_upto``: the sum over the rows of a group up to each, in this order."""
    rows = in_ranges(df, [*map(F.col, by), *order], part_rows)
    near = W.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*by, RANGE).agg(*[F.sum(v).alias(v) for v in values])
    names = {c: f"_by_{i}" for i, c in enumerate(by)}
    bases = totals.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(RANGE).alias("_at"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{i}") for i, v in enumerate(values)])
    bases = materialise(bases, "bases")  # written, so Spark knows its size
    on = F.col(RANGE) == F.col("_at")
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    local = rows.withColumns({f"{v}_upto": F.sum(v).over(near) for v in values})
    sums = {f"{v}_upto": F.col(f"{v}_upto") + F.col(f"_before_{i}") for i, v in enumerate(values)}
    return local.join(bases, on).withColumns(sums).select(*df.columns, *sums)


def ranked(df: DataFrame, order: list[Column], into: str = "rank", *, part_rows: int = PART_ROWS) -> DataFrame:
    """Add the row's number in this order, from 1."""
    one = "_ranked_one"
    rows = running_sums(df.withColumn(one, F.lit(1).cast("long")), [], order, [one], part_rows=part_rows)
    return rows.withColumn(into, F.col(f"{one}_upto")).select(*df.columns, into)
