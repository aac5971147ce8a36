"""Splits, shards and samples that come out the same each time.

The hash modes scale: a row's place is a hash of seed and id. The exact modes follow the
standard library's generator, for parity with seeded lists: a shuffle's draws come from one
task and its order from joins; the exact balanced sample draws row numbers on the driver,
an integer for each row, and is meant for test-sized data.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialise
from . import scan

PLACE = "_place"
#: Draws of a shuffle that are passed on at a time.
DRAWS = 1 << 16


def stable_fraction(key: Column, seed: int = 42) -> Column:
    """In [0, 1): the first 8 bytes of SHA-256 of ``seed:key``, over 2**64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def with_pool(df: DataFrame, key: Column, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``pool``: all rows of a group go to the preference pool or to the training pool."""
    if not 0.0 < ratio < 0.5:
        raise ValueError("the pool's ratio must be between 0 and 0.5")
    return df.withColumn("pool", F.when(stable_fraction(key, seed) < ratio, "preference_pool").otherwise("sft_train"))


def shard_of(order: Column, n: int) -> Column:
    """Round robin by row number."""
    return F.pmod(order, F.lit(n)).cast("int")


def head(df: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    """The first n rows by their number; None takes all."""
    return df if n is None else df.where(F.col(order) < n)


def quotas(pristine: int, manipulated: int, ratio: float) -> tuple[int, int]:
    """How many of each class make the largest sample with this share of pristine rows."""
    if not 0.0 < ratio < 1.0:
        raise ValueError("the share must be between 0 and 1")
    if not pristine or not manipulated:
        raise ValueError("balancing needs rows of both classes")
    total = min(int(pristine / ratio), int(manipulated / (1.0 - ratio)))
    take = min(pristine, round(total * ratio))
    return take, min(manipulated, total - take)


def _counts(df: DataFrame, verdict: str) -> tuple[int, int]:
    n = {r[0]: r[1] for r in df.groupBy(verdict).count().collect()}  # two rows
    return n.get("pristine", 0), n.get("manipulated", 0)


def _order(key: str, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


#: Hex digits of a histogram's step: at most 65,536 buckets a group; rows of a bucket that are ranked.
DIGITS, BUCKET_ROWS = 4, 10_000


def first_by_hash(df: DataFrame, by: str, take: dict[str, int], *, key: str = "id", seed: int = 42) -> DataFrame:
    """Of each group, as many rows of smallest hash as ``take`` says, ties by key; groups that it lacks are left out.

    A radix selection: a histogram of the hashes' first digits finds the bucket that each quota
    ends in, and more digits refine that bucket until it is small. What lies below it is a plain
    filter, what lies above is never looked at, and only the bucket's own rows are ranked.
    """
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(by).alias("_group"), F.col(key).alias("_key"), _order(key, seed).alias("_hash"))
    whole = F.col("_group").isin([g for g, n in take.items() if n > 0])
    cuts: dict[str, tuple[str, int, int]] = {g: ("", n, 0) for g, n in take.items() if n > 0}  # the bucket, how many of its rows, of how many
    open_ = set(cuts)
    for digits in range(DIGITS, 65, DIGITS):
        within = [(F.col("_group") == g) & F.col("_hash").startswith(cuts[g][0]) for g in open_]
        if not within:
            break
        sizes = rows.where(_any(within)).groupBy("_group", F.substring("_hash", 1, digits).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))  # of a histogram
        left = F.create_map(*[x for g in open_ for x in (F.lit(g), F.lit(cuts[g][1]))])[F.col("_group")]
        found = sizes.withColumn("_upto", upto).where((F.col("_upto") >= left) & (F.col("_upto") - F.col("_n") < left)).collect()  # a row a group
        short = open_ - {r["_group"] for r in found}  # groups with fewer rows than asked for
        for g in short:
            cuts[g] = ("", 0, 0)
        for r in found:
            g = r["_group"]
            cuts[g] = (r["_bucket"], cuts[g][1] - (r["_upto"] - r["_n"]), r["_n"])
        open_ = {r["_group"] for r in found if r["_n"] > max(BUCKET_ROWS, cuts[r["_group"]][1])}
    below = [(F.col("_group") == g) & (F.lit(True) if not b else (F.substring("_hash", 1, len(b)) < b) | ((F.substring("_hash", 1, len(b)) == b) & F.lit(k == n))) for g, (b, k, n) in cuts.items()]
    parts = [rows.where(whole & _any(below)).select("_row.*")]
    ranked_ = {g: c for g, c in cuts.items() if c[0] and c[1] < c[2]}
    small = {g: c for g, c in ranked_.items() if c[2] <= BUCKET_ROWS}
    if small:
        inside = rows.where(_any([(F.col("_group") == g) & F.col("_hash").startswith(b) for g, (b, _, _) in small.items()]))
        left = F.create_map(*[x for g, (_, k, _) in small.items() for x in (F.lit(g), F.lit(k))])[F.col("_group")]
        order = W.partitionBy("_group").orderBy("_hash", "_key")  # of a bucket's rows
        parts.append(inside.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= left).select("_row.*"))
    for g in set(ranked_) - set(small):  # one hash that many rows have, so rows of one key
        same = materialise(rows.where((F.col("_group") == g) & (F.col("_hash") == ranked_[g][0])).select("_row"), "same")
        numbered = scan.ranked(same.withColumn("_m", F.monotonically_increasing_id()), [F.col("_m")], "_rank")
        parts.append(numbered.where(F.col("_rank") <= ranked_[g][1]).select("_row.*"))
    return reduce(DataFrame.unionAll, parts)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def balanced_sample(df: DataFrame, ratio: float = 0.5, seed: int = 42, *, verdict: str = "verdict", key: str = "id") -> DataFrame:
    """A class-balanced sample of the rows of smallest hash."""
    return first_by_hash(df, verdict, dict(zip(("pristine", "manipulated"), quotas(*_counts(df, verdict), ratio))), key=key, seed=seed)


def seeded_balanced_order(pristine: list[int], manipulated: list[int], ratio: float, seed: int) -> list[int]:
    """Row numbers of the exact balanced sample, in order."""
    p, m = quotas(len(pristine), len(manipulated), ratio)
    rng = random.Random(seed)
    chosen = rng.sample(pristine, p) + rng.sample(manipulated, m)
    rng.shuffle(chosen)
    return chosen


def _at(df: DataFrame, order: list[int], by: str) -> DataFrame:
    numbers = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(order)], f"_o long, {PLACE} long")
    return df.join(numbers, F.col(by) == F.col("_o")).drop("_o").orderBy(PLACE).drop(PLACE)


def balanced_sample_exact(df: DataFrame, ratio: float = 0.5, seed: int = 42, *, verdict: str = "verdict", order: str = "ord") -> DataFrame:
    """The sample that a seeded list shuffle gives, in its order."""
    rows = sorted(df.select(order, verdict).collect())
    of = lambda v: [r[0] for r in rows if r[1] == v]
    return _at(df, seeded_balanced_order(of("pristine"), of("manipulated"), ratio, seed), order)


def shuffled_head(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Rows in hash order, at most n of them if n is positive."""
    rows = df.orderBy(_order(key, seed), key)
    return rows.limit(n) if n > 0 else rows


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """place and number: where a seeded list shuffle puts the numbers 0 to n - 1.

    The shuffle swaps, from the last place i down, what is at i with what is at a drawn j <= i.
    What is at j then came there with the last swap before that drew j, the one of the least
    i' > i, and what was at i' likewise came from the least i'' > i' that drew i'. So every place
    follows a chain upwards, and all chains are followed at once by pointer doubling. The draws
    are made one after another, as the generator demands, and streamed from one task; all else
    is joins and windows over the few swaps that drew one place.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            bits = random.Random(seed).getrandbits
            for high in range(n - 1, -1, -DRAWS):
                steps, drawn = range(high, max(high - DRAWS, -1), -1), []
                for i in steps:
                    width = (i + 1).bit_length()
                    j = bits(width) if i else 0
                    while j > i:
                        j = bits(width)
                    drawn.append(j)
                yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(drawn, pa.int64())], ["i", "j"])

    swaps = materialise(spark.range(0, 1, 1, 1).mapInArrow(draw, "i long, j long"), "swaps")
    swaps = materialise(swaps.withColumn("above", F.lead("i").over(W.partitionBy("j").orderBy("i"))), "swaps")
    up = materialise(swaps.where("i > j").groupBy(F.col("j").alias("at")).agg(F.min("i").alias("up")), "up")
    while True:
        jumped = up.join(up.select(F.col("at").alias("up"), F.col("up").alias("_next")), "up", "left")
        jumped = materialise(jumped.select("at", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("moved")), "up")
        up = jumped.select("at", "up")
        if jumped.where("moved").isEmpty():
            break
    ends = swaps.join(up.withColumnRenamed("at", "above"), "above", "left")
    return ends.select(F.col("i").alias("place"), F.coalesce("up", "above", "j").alias("number"))


def shuffled_head_exact(df: DataFrame, n: int, seed: int = 42, order: str = "ord") -> DataFrame:
    """Rows in the order of a seeded list shuffle; numbers in ``order`` are distinct."""
    rows = materialise(df.select(F.struct(*df.columns).alias("_row"), F.col(order).alias("_o")), "rows")
    numbered = scan.ranked(rows, [F.col("_o")], "_rank").withColumn("number", F.col("_rank") - 1)
    places = permutation(df.sparkSession, rows.count(), seed)
    joined = numbered.join(places.where(F.col("place") < n) if n > 0 else places, "number")
    return joined.orderBy("place").select("_row.*")
