"""Annotations to chat-format training records."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import build_target, canonical_answer
from ..functions.text import audit_prompt, normalize_caption
from ..types import MAX_WORDS

REQUIRED = ("image", "text", "fake_cls", "fake_text_pos")
#: Fields that a record's id is made of, besides its split and number.
IDENTITY = ("id", "image", "text", "fake_cls", "fake_image_box", "fake_text_pos")


def uid_of(split: str, index: int, annotation: dict) -> str:
    """20 hex digits of SHA-1 of the sorted compact JSON of a record's identity."""
    identity = {"split": split, "index": index} | {k: annotation.get(k) for k in IDENTITY}
    return hashlib.sha1(json.dumps(identity, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:20]


def sample_uid(split: Column, order: Column, raw: Column) -> Column:
    """Needs the raw JSON: the engine's own output differs from it in bytes."""

    @F.pandas_udf("string")
    def uid(split: pd.Series, index: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([uid_of(s, int(i), json.loads(r)) for s, i, r in zip(split, index, raw)])

    return uid(split, order, raw)


def group_key(raw: Column, order: Column) -> Column:
    """Which rows must stay together: the id if the key is there, even as null; else the image; else the row number."""
    keys = F.json_object_keys(raw)
    text = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit("None"))
    return F.when(F.array_contains(keys, "id"), text("id")).when(F.array_contains(keys, "image"), text("image")).otherwise(order.cast("string"))


def missing_fields(raw: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))


def convert(annotations: DataFrame, *, split: str, pool: Column | str, max_words: int = MAX_WORDS, split_field: str = "split") -> DataFrame:
    """Records out of (ord, raw, image_path, width, height), raw being an annotation's JSON.

    Annotations that lack a required field raise.
    """
    parsed = F.from_json("raw", "id string, image string, text string, fake_cls string, fake_image_box array<double>, fake_text_pos array<int>")
    lacks = missing_fields(F.col("raw"))
    df = annotations.withColumn("raw", F.when(F.size(lacks) > 0, F.raise_error(F.concat(F.lit("missing fields: "), F.array_join(lacks, ", "))).cast("string")).otherwise(F.col("raw")))
    df = df.withColumn("a", parsed).withColumn("uid", sample_uid(F.lit(split), F.col("ord"), F.col("raw"))).withColumn("caption", normalize_caption(F.col("a.text"), max_words))
    df = df.withColumn("target", build_target(F.col("a.fake_cls"), F.col("a.fake_image_box"), F.col("a.fake_text_pos"), F.col("width"), F.col("height"), max_words))
    said = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    has_id = F.array_contains(F.json_object_keys("raw"), "id")
    news = F.when(has_id, F.coalesce("a.id", F.lit("None"))).otherwise("")
    meta = F.struct(
        F.col("uid").alias("id"), news.alias("news_id"), F.lit(split).alias(split_field), (F.lit(pool) if isinstance(pool, str) else pool).alias("pool"), F.col("a.fake_cls").alias("fake_cls"), F.col("a.fake_image_box").alias("fake_image_box"),
        F.col("a.fake_text_pos").alias("fake_text_pos"), F.col("caption").alias("normalized_text"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.col("target").alias("target"),
    )
    talk = F.array(said("human", audit_prompt(F.col("caption"))), said("gpt", canonical_answer(F.col("target"))))
    return df.select("ord", F.col("uid").alias("id"), F.array("image_path").alias("images"), talk.alias("conversations"), meta.alias("meta"))


def summarize(records: DataFrame) -> DataFrame:
    """Counts by label and by verdict, and of all, in one pass: label, verdict (null where summed over), n."""
    flat = records.select(F.col("meta.fake_cls").alias("label"), F.col("meta.target.verdict").alias("verdict"))
    return flat.groupingSets([["label"], ["verdict"], []], "label", "verdict").agg(F.count(F.lit(1)).alias("n"))
