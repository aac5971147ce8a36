"""Aligning predictions with ground truth, and the guards around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def _first_ids(df: DataFrame, key: str, n: int = 3) -> list[str]:
    return [str(r[0]) for r in df.select(key).limit(n).collect()]


def align(truth: DataFrame, predictions: DataFrame, *, key: str = "id", order: str = "ord", allow_positional: bool = False) -> DataFrame:
    """Truth with the one prediction of its id; prediction columns that clash are prefixed ``pred_``.

    Duplicate prediction ids and truth without a prediction raise; more predictions are
    ignored. Where a prediction has no id, rows meet by ``order`` if that is allowed and both
    sides have as many. Keys are compared as text, or as numbers where both are whole ones. One aggregate of both sides' keys checks
    all that; the join itself is left to the optimiser.
    """
    clash = set(truth.columns) & set(predictions.columns)
    pred = predictions.select(*[F.col(c).alias(f"pred_{c}" if c in clash else c) for c in predictions.columns])
    pkey, pord = (f"pred_{c}" if c in clash else c for c in (key, order))
    kind = "long" if all(isinstance(df.schema[key].dataType, IntegralType) for df in (truth, predictions)) else "string"
    sides = truth.select(F.col(key).cast(kind).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(predictions.select(F.col(key).cast(kind).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    by_key = sides.groupBy("k").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    named = F.col("k").isNotNull()
    alone = (F.col("t") > 0) & ((F.col("p") == 0) | ~named)
    n = by_key.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("truth"), F.coalesce(F.sum("p"), F.lit(0)).alias("predictions"), F.coalesce(F.sum(F.when(~named, F.col("p"))), F.lit(0)).alias("unnamed"),
        F.count_if(named & (F.col("p") > 1)).alias("repeated"), F.coalesce(F.sum(F.when(alone, F.col("t"))), F.lit(0)).alias("lost"), F.min(F.when(alone, F.coalesce(F.col("k").cast("string"), F.lit("None")))).alias("first"),
    ).first()
    if not n["unnamed"]:
        if n["repeated"]:
            raise ValueError("prediction ids are not unique")
        if n["lost"]:
            raise ValueError(f"{n['lost']} ids have no prediction, the first of them {n['first']}")
        return truth.join(pred, truth[key].cast(kind) == pred[pkey].cast(kind))
    if not allow_positional:
        raise ValueError("predictions lack ids")
    if n["truth"] != n["predictions"]:
        raise ValueError(f"positions don't match: {n['truth']} rows and {n['predictions']} predictions")
    return truth.join(pred, truth[order] == pred[pord])


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id has no output yet."""
    finished = done.select(F.col(key).cast("string").alias("_done")).where("_done is not null").distinct()
    return rows.join(finished, rows[key].cast("string") == finished["_done"], "left_anti")


def in_train_pool(split: Column, pool: Column) -> Column:
    return split.eqNullSafe(F.lit("train")) & pool.eqNullSafe(F.lit("preference_pool"))


def require_train_pool(rows: DataFrame, *, split: str = "split", pool: str = "pool", key: str = "id") -> DataFrame:
    """The rows, if all are of the train split's preference pool; else an error naming three that aren't."""
    if wrong := _first_ids(rows.where(~in_train_pool(F.col(split), F.col(pool))), key):
        raise ValueError(f"not of the train split's preference pool: {wrong}")
    return rows


def validate_outputs(truth: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """One row: expected, rows, unique_ids and whether they agree."""
    expected = truth.agg(F.count(F.lit(1)).alias("expected"))
    got = outputs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("unique_ids"))
    both = expected.join(F.broadcast(got), F.lit(True))  # a row each
    return both.withColumn("ok", (F.col("rows") == F.col("expected")) & (F.col("unique_ids") == F.col("expected")))


def require_valid_outputs(truth: DataFrame, outputs: DataFrame, key: str = "id") -> int:
    """How many outputs there are; raises unless each row has one, and no id two."""
    got = validate_outputs(truth, outputs, key).first()
    if not got["ok"]:
        raise ValueError(f"outputs don't match: {got['expected']} rows, {got['rows']} outputs of {got['unique_ids']} ids")
    return got["rows"]


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: empty if two pools share no group."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
