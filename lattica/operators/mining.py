"""Preference pairs from wrong responses, and prompts for policy training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonical_answer
from ..functions.scoring import error_tags, rejected_text
from ..functions.text import strip_image_token
from .sampling import shuffled_head, shuffled_head_exact


def first_user_turn(conversations: Column, key: Column) -> Column:
    """The opening turn; raises unless a human opens."""
    first = F.get(conversations, F.lit(0))
    turn = F.struct(F.lit("human").alias("from"), F.coalesce(first["value"], F.lit("")).alias("value"))
    wrong = F.raise_error(F.concat(F.lit("no human turn opens record "), F.coalesce(key.cast("string"), F.lit("<unknown>"))))
    return F.when(first["from"] == "human", turn).otherwise(wrong.cast("struct<from:string,value:string>"))


def first_user_prompt(conversations: Column, key: Column) -> Column:
    return strip_image_token(first_user_turn(conversations, key)["value"])


def mark_errors(aligned: DataFrame, *, bbox_threshold: float = 0.5, text_f1_threshold: float = 1.0, include_pristine: bool = False) -> DataFrame:
    """Eligible rows (target, parsed, response) with their error tags."""
    rows = aligned if include_pristine else aligned.where(F.col("target.verdict") != "pristine")
    return rows.withColumn("error_tags", error_tags(F.col("target"), F.col("parsed"), bbox_threshold, text_f1_threshold))


def preference_pairs(marked: DataFrame, *, mined_from: str = "", max_pairs: int = 5000, seed: int = 42, exact: bool = False) -> DataFrame:
    """chosen and rejected answers of rows with errors, shuffled; at most max_pairs if positive."""
    bad = marked.where(F.size("error_tags") > 0)
    bad = shuffled_head_exact(bad, max_pairs, seed) if exact else shuffled_head(bad, max_pairs, seed)
    said = lambda c: F.struct(F.lit("gpt").alias("from"), c.alias("value"))
    keep = [c for c in ("id", "images") if c in bad.columns]
    turn = [F.array(F.get("conversations", F.lit(0))).alias("conversations")] if "conversations" in bad.columns else []
    tags, source = F.col("error_tags"), F.lit(mined_from)
    if "meta" in bad.columns:
        meta = F.col("meta").withField("error_tags", tags).withField("mined_from", source)
    else:
        meta = F.struct(tags.alias("error_tags"), source.alias("mined_from"))
    return bad.select(*keep, *turn, said(canonical_answer(F.col("target"))).alias("chosen"), said(rejected_text(F.col("response"))).alias("rejected"), meta.alias("meta"))


def mining_report(marked: DataFrame) -> DataFrame:
    """One row: eligible rows, their share of valid responses, and rows with an error."""
    valid = F.coalesce(F.avg(F.col("parsed.valid").cast("double")), F.lit(0.0))
    return marked.agg(F.count(F.lit(1)).alias("eligible"), valid.alias("valid_prediction_rate"), F.count_if(F.size("error_tags") > 0).alias("badcases"))


def policy_prompts(rows: DataFrame, key: str = "id") -> DataFrame:
    """id, images, the opening turn and meta."""
    keep = [c for c in (key, "images", "meta") if c in rows.columns]
    return rows.select(*keep, F.array(first_user_turn(F.col("conversations"), F.col(key))).alias("conversations"))


def training_rows(rows: DataFrame, key: str = "id") -> DataFrame:
    """id, prompt messages, first image and target."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), first_user_prompt(F.col("conversations"), F.col(key)).alias("content")))
    return rows.select(key, prompt.alias("prompt"), F.get("images", F.lit(0)).alias("image"), F.col("meta.target").alias("target"))
