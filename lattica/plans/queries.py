"""Registered queries: operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, labels, scoring, text
from ..functions.parse import parse_response
from ..operators import align, compare, convert, infer, metrics, mining, rewards, sampling
from ..sources import commits, documents, images, records
from ..storage import materialise, shared_dir
from .audit import aligned, annotations, keys, responses, table, truth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(xs: Column) -> Column:
    return F.array_join(xs.cast("array<string>"), ",")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_rows(aligned(spark, sf_dir))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_type(scored(spark, sf_dir), F.col("target"), F.col("type_vector"), F.col("has_types"), F.col("parsed.types"))


# --- row transforms


@query
def caption_normalize(spark, sf_dir):
    done = text.normalize_caption(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", done.alias("caption"), text.count_words(done).alias("n_words"))


@query
def build_target(spark, sf_dir):
    t = F.col("target")
    return truth(spark, sf_dir).select("id", t["verdict"].alias("verdict"), joined(t["types"]).alias("types"), joined(t["image_bbox"]).alias("box"), joined(t["text_positions"]).alias("positions"))


@query
def canonical_answer(spark, sf_dir):
    return truth(spark, sf_dir).select("id", labels.canonical_answer(F.col("target")).alias("answer"))


@query
def bbox_normalize(spark, sf_dir):
    width, height = (F.col("c") % 640 + 1).cast("int"), (F.col("k") % 480 + 1).cast("int")
    box = labels.normalize_bbox(F.col("box"), width, height)
    return annotations(spark, sf_dir).select(F.col("k").alias("id"), *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query
def prompts(spark, sf_dir):
    t = truth(spark, sf_dir)
    asked = text.type_prompts(F.col("caption"))
    return t.select("id", F.md5(text.audit_prompt(F.col("caption"))).alias("audit"), text.verdict_prompt(F.col("caption")).alias("judge"), F.get(asked, F.lit(2))["prompt"].alias("third"), text.strip_image_token(F.concat(F.lit(" <image>\n"), F.lit("<image>  "), F.col("caption"))).alias("stripped"))


@query
def sample_uid(spark, sf_dir):
    return _raw(spark, sf_dir).select(F.col("ord").alias("id"), convert.sample_uid(F.lit("train"), F.col("ord"), F.col("raw")).alias("uid"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as JSON text, with their row numbers; every fifth lacks an id."""
    fields = [F.when(F.col("c") % 5 != 0, F.concat(F.lit('"id":"n'), (F.col("c") % 50).cast("string"), F.lit('",'))).otherwise("")]
    fields += [F.lit('"image":"i'), F.col("k").cast("string"), F.lit('.png","text":"A-B/<person>,  says '), F.col("k").cast("string"), F.lit('","fake_cls":"'), F.col("label")]
    fields += [F.lit('","fake_image_box":['), joined(F.col("box")), F.lit('],"fake_text_pos":['), joined(F.col("positions")), F.lit("]")]
    raw = F.concat(F.lit("{"), *fields, F.lit("}"))
    return annotations(spark, sf_dir).select(F.col("k").alias("ord"), raw.alias("raw"), F.concat(F.lit("/images/i"), F.col("k").cast("string"), F.lit(".png")).alias("image_path"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))


@query
def convert_records(spark, sf_dir):
    pool = F.when(sampling.stable_fraction(convert.group_key(F.col("raw"), F.col("ord"))) < 0.1, "preference_pool").otherwise("sft_train")
    m = F.col("meta")
    done = convert.convert(_raw(spark, sf_dir), split="train", pool=pool)
    return done.select(F.col("ord").alias("id"), F.col("id").alias("uid"), m["news_id"].alias("news_id"), m["pool"].alias("pool"), m["normalized_text"].alias("caption"), F.get("conversations", F.lit(1))["value"].alias("answer"), F.get("images", F.lit(0)).alias("image"))


@query
def response_fields(spark, sf_dir):
    """The first response field that a prediction's JSON has, be it with a null, and id or else meta.id."""
    k, text = F.col("id"), F.to_json(F.struct(F.col("response").alias("r")))
    said = F.substr(text, F.lit(6), F.length(text) - 6)
    raw = F.concat(F.lit('{"output":"other"'), F.when(k % 4 == 1, F.lit(',"prediction":null')).otherwise(F.concat(F.lit(',"predict":'), F.when(k % 4 == 2, "null").otherwise(said))), F.lit("}"))
    df = responses(spark, sf_dir).select(F.when(k % 3 != 0, k).alias("id"), F.struct("id").alias("meta"), raw.alias("raw"))
    return df.select(scoring.row_id(df.columns).alias("id"), scoring.response_text(F.col("raw")).alias("response"))


@query
def score_vectors(spark, sf_dir):
    """Clamped scores, with a fallback to the verdict and types where there are none."""
    df = aligned(spark, sf_dir)
    some = F.when(F.col("id") % 3 != 0, F.col("manipulated_score") * 2 - 0.5)
    named = F.when(F.col("id") % 4 != 0, F.col("type_scores"))
    one, four = scoring.binary_score(some, F.col("parsed")), scoring.type_scores(named, F.col("parsed"))
    return df.select("id", r6(one["score"]).alias("score"), one["given"].alias("given"), *[r6(F.get(four["scores"], F.lit(i))).alias(f"s{i}") for i in range(4)], four["given"].alias("given_types"))


@query
def type_score_lists(spark, sf_dir):
    """Type scores as a prediction's JSON gives them: by name, as a list of four, as a list of three, which doesn't count, or not at all."""
    k, one = F.col("id"), lambda i: F.element_at(F.map_values("type_scores"), i + 1)
    numbers = lambda n: F.array_join(F.array(*[(one(i) * 2 - 0.5).cast("string") for i in range(n)]), ",")
    given = F.when(k % 4 == 0, F.concat(F.lit('{"type_scores":{"text_swap":'), one(2).cast("string"), F.lit("}}"))).when(k % 4 == 1, F.concat(F.lit('{"type_scores":['), numbers(4), F.lit("]}"))).when(k % 4 == 2, F.concat(F.lit('{"type_scores":['), numbers(3), F.lit("]}"))).otherwise("{}")
    named, listed = scoring.given_type_scores(F.col("given"))
    df = aligned(spark, sf_dir).withColumn("given", given).withColumns({"type_scores": named, "type_list": listed})
    done = metrics.score_rows(df)
    return done.select("id", *[r6(F.get("type_vector", F.lit(i))).alias(f"s{i}") for i in range(4)], "has_types")


@query
def json_path_numbers(spark, sf_dir):
    """A finite number in a JSON column; anything else is null."""
    n = F.get_json_object("props", "$.k").try_cast("double")
    finite = F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)
    return table(spark, sf_dir, "events").select("event_id", finite.alias("value"), (finite * 100.0).alias("percent"))


@query
def comma_lists(spark, sf_dir):
    raw = F.concat(F.lit(" a"), F.col("k").cast("string"), F.lit(" , ,b,"), F.when(F.col("k") % 2 == 0, F.col("c").cast("string")).otherwise(" "))
    return keys(spark, sf_dir).select(F.col("k").alias("id"), joined(text.comma_list(raw)).alias("items"))


@query
def image_dimensions(spark, sf_dir):
    """Sizes from image headers."""
    hexes = lambda v: F.lpad(F.hex(v), 8, "0")
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexes(F.col("k") % 4000 + 1), hexes(F.col("c") % 3000 + 1))
    size = images.image_size(F.unhex(head), verify=False)
    return keys(spark, sf_dir).withColumn("s", size).select(F.col("k").alias("id"), F.col("s.width").alias("width"), F.col("s.height").alias("height"))


@query
def parse_response_rows(spark, sf_dir):
    p = F.col("p")
    df = responses(spark, sf_dir).withColumn("p", parse_response(F.col("response")))
    return df.select("id", p["valid"].alias("valid"), p["verdict"].alias("verdict"), joined(p["types"]).alias("types"), joined(F.transform(p["image_bbox"], lambda v: v.cast("int"))).alias("box"), joined(p["text_positions"]).alias("positions"), F.substring_index(p["error"], ":", 1).alias("error"))


# --- sources and sinks


@query
def json_lines_round_trip(spark, sf_dir):
    """Compact JSON lines written and read again."""
    path = shared_dir(spark) + "/lines"
    records.write_lines(truth(spark, sf_dir).select("id", "label", "target").orderBy("id"), path)
    back = records.parse_records(records.read_records(spark, path), "id long, label string, target struct<verdict:string,types:array<string>,image_bbox:array<int>,text_positions:array<int>>")
    return back.select("id", "label", F.col("target.verdict").alias("verdict"), joined(F.col("target.image_bbox")).alias("box"))


@query
def split_union(spark, sf_dir):
    """Split files written and read as one table, with their row numbers; blank lines don't count."""
    folder = shared_dir(spark) + "/splits"
    rows = truth(spark, sf_dir)
    for i, s in enumerate(("train", "val", "test")):
        part = rows.where(F.col("id") % 3 == i).select(F.to_json(F.struct("id", "label")).alias("value"))
        part.unionByName(spark.range(3).select(F.lit("  ").alias("value"))).coalesce(1).write.text(f"{folder}/{s}.json")
    back = records.read_splits(spark, folder)
    fields = F.from_json("raw", "id long, label string")
    return back.select(fields["id"].alias("id"), fields["label"].alias("label"), "split", "ord").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.countDistinct("ord").alias("numbers"), F.sum(F.length("label")).alias("letters"))


@query
def array_records(spark, sf_dir):
    """All records as one JSON array in one file, read by its blocks, element by element with row numbers."""
    path = shared_dir(spark) + "/array"
    least = truth(spark, sf_dir).agg(F.min("id")).first()[0]
    rows = truth(spark, sf_dir).select("id", F.concat(F.when(F.col("id") == least, "[").otherwise(","), F.to_json(F.struct("id", F.concat("label", F.lit('"}],[{\\')).alias("label"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})).alias("value"))
    ends = spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit("]").alias("value"))
    rows.unionByName(ends).orderBy(F.col("id").asc_nulls_last()).coalesce(1).select("value").write.text(path)
    back = records.read_records(spark, path)
    return back.select("ord", F.get_json_object("raw", "$.id").cast("long").alias("id"), F.get_json_object("raw", "$.label").alias("label"), F.json_object_keys("raw")[2].alias("third"))


@query
def append_records(spark, sf_dir):
    """JSON lines written in batches, each of them twice, and one that was cut off before its commit: all count once."""
    path = shared_dir(spark) + "/appended"
    rows = truth(spark, sf_dir).select("id", "label")
    even, odd = ([commits.append_batch(rows.where(F.col("id") % 2 == i), path, f"batch-{i}") for _ in range(2)] for i in range(2))
    records.write_lines(rows.where("id % 2 = 0"), f"{path}/batch-2-attempt")  # no commit names it
    back = records.parse_records(records.read_records(spark, path), "id long, label string")
    sums = back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("ord").alias("numbers"))
    return sums.select("*", *[F.lit(n).cast("long").alias(c) for c, n in zip(("first", "first_again", "second", "second_again"), (*even, *odd))])


@query
def image_paths(spark, sf_dir):
    """Where images are: below root, below root without a folder of root's name, or beside root."""
    rows = keys(spark, sf_dir).select(F.col("k").alias("id"), F.concat(F.when(F.col("k") % 3 == 1, "Data/").otherwise(""), F.lit("i"), F.col("k").cast("string"), F.lit(".png")).alias("image"))
    k = F.col("k").cast("string")
    listing = keys(spark, sf_dir).select(F.concat(F.when(F.col("k") % 3 == 2, "/x/i").otherwise("/x/data/i"), k, F.lit(".png")).alias("path"), F.col("c").alias("width"))
    return images.resolve(rows, listing, "/x/data").select("id", "image_path", "width")


@query
def trainer_rows(spark, sf_dir):
    """Prompt messages, first image and target of records; the prompt is the opening turn without its image mark."""
    rows = truth(spark, sf_dir)
    talk = F.array(F.struct(F.lit("human").alias("from"), F.concat(F.lit("<image>\n"), "caption").alias("value")))
    rows = rows.select("id", F.array(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit("second")).alias("images"), talk.alias("conversations"), F.struct("target").alias("meta"))
    done = mining.training_rows(rows)
    return done.select("id", F.get("prompt", F.lit(0))["role"].alias("role"), F.get("prompt", F.lit(0))["content"].alias("content"), "image", F.col("target.verdict").alias("verdict"))


# --- splits, samples, shards


@query
def stable_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.with_pool(docs.select("doc_id", "source"), F.col("source"), 0.2).select("doc_id", "pool", r6(sampling.stable_fraction(F.col("source"))).alias("fraction"))


@query
def split_leak_check(spark, sf_dir):
    """Sources on both sides: none where they are split by source, some where by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = []
    for by in ("source", "doc_id"):
        rows = sampling.with_pool(docs, F.col(by).cast("string"), 0.2)
        found.append(align.shared_keys(rows.where("pool = 'preference_pool'"), rows.where("pool = 'sft_train'"), "source").select(F.lit(by).alias("split_by"), "source"))
    return records.union(found)


@query
def balanced_sample(spark, sf_dir):
    rows = truth(spark, sf_dir).select("id", F.col("target.verdict").alias("verdict"))
    return sampling.balanced_sample(rows, 0.4, 42)


@query
def shuffled_head(spark, sf_dir):
    return sampling.shuffled_head(truth(spark, sf_dir).select("id", "label"), 500, 42)


@query
def head_limit(spark, sf_dir):
    return sampling.head(truth(spark, sf_dir), 1000).select("id", "label")


@query
def shard_assign(spark, sf_dir):
    return truth(spark, sf_dir).groupBy(sampling.shard_of(F.col("ord"), 7).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query
def shard_validate(spark, sf_dir):
    rows = truth(spark, sf_dir)
    shards = records.union([rows.where(sampling.shard_of(F.col("ord"), 3) == i) for i in range(3)])
    return align.validate_outputs(rows, shards)


# --- joins


@query
def align_strict(spark, sf_dir):
    both = align.align(truth(spark, sf_dir), responses(spark, sf_dir).where("id >= 0"))
    return both.select("id", "response", "label")


@query
def align_positional(spark, sf_dir):
    pred = responses(spark, sf_dir).withColumn("id", F.lit(None).cast("long"))
    return align.align(truth(spark, sf_dir), pred, allow_positional=True).select("id", "response")


@query
def resume_anti(spark, sf_dir):
    done = responses(spark, sf_dir).where(F.col("id") % 3 == 0)
    return align.pending(truth(spark, sf_dir), done).select("id", "label")


@query
def leakage_guard(spark, sf_dir):
    """Rows of the train split's preference pool, and which of all rows the guard would refuse."""
    pool = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "sft_train").otherwise("preference_pool")
    rows = truth(spark, sf_dir).withColumns({"split": F.when(F.col("id") % 7 == 0, "val").otherwise("train"), "pool": pool})
    good = align.in_train_pool(F.col("split"), F.col("pool"))
    return align.require_train_pool(rows.where(good)).select("id", F.lit(True).alias("allowed")).unionByName(rows.where(~good).select("id", F.lit(False).alias("allowed")))


# --- metrics


@query
def bbox_iou(spark, sf_dir):
    done = geometry.bbox_iou(F.col("target.image_bbox"), F.col("parsed.image_bbox"))
    return aligned(spark, sf_dir).select("id", r6(done).alias("iou"), r6(geometry.bbox_area_ratio(F.col("parsed.image_bbox"))).alias("area"))


@query
def set_f1(spark, sf_dir):
    return aligned(spark, sf_dir).select("id", r6(geometry.set_f1(F.col("target.text_positions"), F.col("parsed.text_positions"))).alias("f1"))


@query
def error_tags(spark, sf_dir):
    return scored(spark, sf_dir).select("id", joined(F.col("errors")).alias("errors"))


@query
def error_tag_histogram(spark, sf_dir):
    return metrics.tag_counts(scored(spark, sf_dir))


@query
def bad_cases(spark, sf_dir):
    return metrics.bad_cases(scored(spark, sf_dir)).select("id", F.size("errors").alias("n"))


@query
def binary_confusion(spark, sf_dir):
    done = metrics.rates(metrics.confusion(scored(spark, sf_dir)))
    return done.select("tp", "tn", "fp", "fn", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")])


@query
def generated_confusion(spark, sf_dir):
    """Without scores: what the verdicts say, unparseable ones being wrong."""
    plain = metrics.score_rows(aligned(spark, sf_dir).withColumns({"manipulated_score": F.lit(None).cast("double"), "type_scores": F.lit(None).cast("map<string,double>")}))
    return metrics.confusion(plain)


@query
def auc(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir)).select(r6("auc").alias("auc"))


@query
def eer(spark, sf_dir):
    return metrics.eer(scored(spark, sf_dir)).select(r6("eer").alias("eer"))


@query
def average_precision(spark, sf_dir):
    return metrics.average_precision(typed(spark, sf_dir), by=["type"]).select("type", r6("ap").alias("ap"))


@query
def mean_average_precision(spark, sf_dir):
    return metrics.mean_average_precision(metrics.average_precision(typed(spark, sf_dir), by=["type"])).select(r6("map").alias("map"))


@query
def per_class_f1(spark, sf_dir):
    return metrics.per_class(typed(spark, sf_dir)).select("type", "tp", "fp", "fn", r6("f1").alias("f1"))


@query
def micro_macro_f1(spark, sf_dir):
    done = metrics.micro_macro(metrics.per_class(typed(spark, sf_dir)))
    return done.select(*[r6(F.col(f"`{c}`")).alias(c) for c in ("op", "or", "of1", "cp", "cr", "cf1")])


@query
def grounding_summary(spark, sf_dir):
    """Every metric that is a plain sum, in one pass."""
    done = metrics.grounding(scored(spark, sf_dir))
    rates = ("json_valid_rate", "verdict_accuracy", "types_exact_match", "mean_iou", "iou_at_50", "iou_at_75", "iou_at_95", "badcase_rate", "evidence_hallucination_rate")
    return done.select("num_samples", *[r6(c).alias(c) for c in rates], "tp", "tn", "fp", "fn", "badcase_count", "all_scores", "all_types")


@query
def official_percent(spark, sf_dir):
    """The 22 headline metrics."""
    rows = scored(spark, sf_dir).persist()
    try:
        tree = metrics.evaluate(rows)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(k, round(v, 4)) for k, v in tree["official_metrics_percent"].items()], "metric string, value double")


@query
def subword_confusion(spark, sf_dir):
    """Words of two characters a sub-word."""
    halves = lambda t: [i for i, w in enumerate(t.split()) for _ in range((len(w) + 1) // 2)]
    df = aligned(spark, sf_dir)
    return metrics.subword_counts(df, halves).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])


# --- rewards, mining, comparison, models


@query
def case_weights(spark, sf_dir):
    done = rewards.case_weights(rewards.count_cases(truth(spark, sf_dir)))
    return done.select("case", "n", r6("weight").alias("weight"))


def _rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.score_rewards(aligned(spark, sf_dir), rewards.case_weights(rewards.count_cases(truth(spark, sf_dir))))


@query
def reward_breakdown(spark, sf_dir):
    b = F.col("breakdown")
    parts = ("task_reward", "verdict_reward", "type_reward", "evidence_reward", "penalty")
    return _rewarded(spark, sf_dir).select("id", r6("reward").alias("reward"), b["case"].alias("case"), *[r6(b[p]).alias(p) for p in parts], b["valid"].alias("valid"))


@query
def reward_summary(spark, sf_dir):
    done = rewards.reward_summary(_rewarded(spark, sf_dir))
    return done.select("count", *[r6(c).alias(c) for c in ("mean_reward", "min_reward", "max_reward", "mean_penalty", "valid_rate")])


@query
def reward_callback(spark, sf_dir):
    """The trainer's callable over message-shaped completions, two of each target."""

    @F.pandas_udf("double")
    def call(response: pd.Series, target: pd.DataFrame) -> pd.Series:
        rows = [{"verdict": v, "types": list(t), "image_bbox": None if b is None else list(b), "text_positions": list(p)} for v, t, b, p in zip(*(target[c] for c in ("verdict", "types", "image_bbox", "text_positions")))]
        twice = [[{"role": "assistant", "content": r}] for r in response for _ in range(2)]
        return pd.Series(rewards.make_reward()(twice, target=rows)[::2], dtype="float64")

    return aligned(spark, sf_dir).select("id", r6(call("response", "target")).alias("reward"))


@query
def preference_pairs(spark, sf_dir):
    rows = aligned(spark, sf_dir).withColumn("conversations", F.array(F.struct(F.lit("human").alias("from"), F.col("caption").alias("value"))))
    pairs = mining.preference_pairs(mining.mark_errors(rows), mined_from="run", max_pairs=2000, seed=42)
    return pairs.select("id", F.col("chosen.value").alias("chosen"), F.col("rejected.value").alias("rejected"), joined(F.col("meta.error_tags")).alias("tags"))


@query
def mining_report(spark, sf_dir):
    done = mining.mining_report(mining.mark_errors(aligned(spark, sf_dir)))
    return done.select("eligible", r6("valid_prediction_rate").alias("valid_prediction_rate"), "badcases")


@query
def policy_prompts(spark, sf_dir):
    """The opening turn of every conversation: its turns of users in order, the first being a human's."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))  # as many as a conversation's turns
    rows = turns.groupBy(F.col("conv_id").alias("id")).agg(F.transform(said, lambda t: F.struct(F.lit("human").alias("from"), t["text"].alias("value"))).alias("conversations"))
    return mining.policy_prompts(rows).select("id", F.get("conversations", F.lit(0))["value"].alias("prompt"))


@query
def candidate_softmax(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "yes").otherwise("no").alias("candidate"), (-F.col("l_quantity") / 10).alias("logprob"))
    return infer.candidate_scores(item, "no", "yes").select("id", r6("score").alias("score"))


@query
def mean_logprobs(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "yes").otherwise("no").alias("candidate"), (-F.col("l_quantity") / 10).alias("logprob"))
    return infer.mean_logprobs(item).select("id", "candidate", r6("mean_logprob").alias("mean_logprob"))


@query
def case_histogram(spark, sf_dir):
    return rewards.count_cases(truth(spark, sf_dir))


@query
def pool_partition(spark, sf_dir):
    """Every row is in exactly one of two pools."""
    rows = sampling.with_pool(truth(spark, sf_dir).select("id"), F.col("id") % 100, 0.3)
    return rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct(F.col("id") % 100).alias("groups"))


@query
def resume_predictions(spark, sf_dir):
    """A deterministic stand-in for a model, over rows that have no output yet."""
    rows = truth(spark, sf_dir).select("id", F.concat(F.lit(" "), "label").alias("prompt"))
    done = rows.where(F.col("id") % 2 == 0)
    return infer.predict(rows, lambda: lambda asked: [p.upper() for p in asked], done=done).select("id", "response", "score_method")


class _Stub:
    """A deterministic stand-in for a model: what it thinks of a candidate is made of lengths."""

    def __call__(self, asked: list[str]) -> list[str]:
        return [f" {len(p)} " for p in asked]

    def mean_logprobs(self, asked: list[str], candidate: str) -> list[float]:
        return [-((len(p) * len(candidate)) % 7) / 2.0 for p in asked]


@query
def scored_predictions(spark, sf_dir):
    """Answers with a score of the verdict and of each type."""
    turn = F.array(F.struct(F.lit("human").alias("from"), F.concat(F.lit("<image>\n"), "caption").alias("value")))
    rows = truth(spark, sf_dir).select("id", F.array(F.lit("i")).alias("images"), turn.alias("conversations"), F.struct(F.col("caption").alias("normalized_text")).alias("meta"))
    done = infer.predict(infer.prompts(rows), _Stub, mode="full")
    return done.select(F.col("id").cast("long").alias("id"), "response", r6("manipulated_score").alias("score"), r6(F.col("type_scores")["face_swap"]).alias("first"), r6(F.col("type_scores")["text_attribute"]).alias("last"), "score_method")


@query
def word_pieces(spark, sf_dir):
    """Confusion at the level of sub-words, as ``evaluate`` counts them; the tokenizer splits words of more than two characters in pairs."""
    pairs = lambda text: [i for i, w in enumerate(text.split()) for _ in range((len(w) + 1) // 2)]
    rows = materialise(metrics.score_rows(aligned(spark, sf_dir)), "scored")
    tree = metrics.evaluate(rows, subwords=metrics.subword_counts(rows, pairs, max_length=40), subword_name="pairs", max_length=40)
    found = tree["text_grounding"]["official_bert_token_level"]
    return spark.createDataFrame([(k, float(found[k])) for k in ("tp", "tn", "fp", "fn")] + [("f1_percent", round(tree["official_metrics_percent"]["F1_tok"], 4))], "metric string, value double")


@query
def tokenizer_pieces(spark, sf_dir):
    """Confusion at the level of sub-words of a public tokenizer's file, of which the first 38 of a caption count."""
    import public_tokenizers

    numbers = metrics.word_numbers(public_tokenizers.path("word_bpe_49k.json"))
    counts = metrics.subword_counts(aligned(spark, sf_dir), numbers, max_length=40)
    return counts.agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "tn", "fp", "fn")])


def run_documents(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """run and document: what a run with a customer's even or odd orders has as its metrics."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == odd)
    n, high, low = F.count(F.lit(1)), F.count_if(F.col("o_totalprice") > 150_000), F.count_if(F.col("o_orderpriority") < "2")
    f1 = lambda c: F.struct(c.alias("f1"))
    document = F.struct(
        F.struct((high / n).alias("auc"), (low / n).alias("eer"), n.cast("string").alias("accuracy")).alias("binary_classification"),
        F.struct(F.when(F.col("run") % 3 != 0, f1(high + 0)).alias("official_bert_token_level"), f1(low + 0).alias("word_level")).alias("text_grounding"),
        F.when(low == 0, "inf").otherwise(F.concat(F.lit(" "), low.cast("string"), F.lit("e-1"))).alias("json_valid_rate"),
        F.struct(F.struct(F.lit(0.5).alias("face_swap"), F.lit(None).cast("double").alias("text_swap")).alias("per_class_f1")).alias("multilabel_classification"),
    )
    return orders.groupBy(F.col("o_custkey").alias("run")).agg(F.to_json(document).alias("document"))


@query
def metric_tree(spark, sf_dir):
    """Comparable metrics out of each run's document of nested objects; text at the best level, numbers as text count, infinite ones don't."""
    return compare.metric_rows(run_documents(spark, sf_dir, 0)).where("value is not null").select("run", "metric", "higher", r6("value").alias("value"))


@query
def report_rows(spark, sf_dir):
    """Comparisons of two runs each, as lines of text: six decimals, signed differences, percent of errors that went."""
    before, after = (compare.metric_rows(run_documents(spark, sf_dir, odd)) for odd in (0, 1))
    done = compare.compare_metrics(before, after, by=("run",)).where("comparison is not null and metric in ('binary_auc', 'binary_eer')")
    return done.select("run", compare.report_line(F.col("metric"), F.col("comparison")).alias("line"))


@query
def registry_entries(spark, sf_dir):
    """How a trainer reads each data set that the records are dealt to: file, format, columns, and the records in it."""
    found = documents.registry("p")
    names = F.array(*map(F.lit, found))
    dealt = truth(spark, sf_dir).groupBy(names[(F.col("id") % len(found)).cast("int")].alias("name")).agg(F.count(F.lit(1)).alias("n"))
    entries = spark.createDataFrame([(k, v["file_name"], v["formatting"], bool(v.get("ranking")), ",".join(sorted(v["columns"]))) for k, v in found.items()], "name string, file_name string, formatting string, ranking boolean, columns string")
    return dealt.join(F.broadcast(entries), "name")  # six entries


@query
def auc_sketch(spark, sf_dir):
    """The area under the curve from a mergeable sketch of each class's scores, with its error's bound; merged from two halves."""
    rows = aligned(spark, sf_dir).select("id", F.col("manipulated_score").alias("score"), (F.col("target.verdict") == "manipulated").cast("int").alias("label"))
    halves = [metrics.score_sketch(rows.where(F.col("id") % 2 == i), bins=256) for i in (0, 1)]
    exact = metrics.auc(rows)
    both = metrics.sketch_auc(metrics.merge_sketches(*halves)).crossJoin(exact.select(F.col("auc").alias("exact")))  # a row each
    return both.select(r6("auc").alias("auc"), r6("error").alias("error"), (F.abs(F.col("auc") - F.col("exact")) <= F.col("error")).alias("within"))


@query
def compare_runs(spark, sf_dir):
    """Mean scores by priority of two runs; the second has lower errors for some."""
    orders = table(spark, sf_dir, "orders")
    higher = F.col("o_orderpriority") < "3"
    run = lambda shift: orders.groupBy(F.col("o_orderpriority").alias("metric"), higher.alias("higher")).agg(F.avg(((F.col("o_orderkey") * shift) % 101) / 100.0).alias("value"))
    c = F.col("comparison")
    done = compare.compare_metrics(run(3), run(7).where("metric <> '5-LOW'"))
    return done.select("metric", *[r6(c[n]).alias(n) for n in ("before", "after", "absolute_delta", "relative_error_reduction")], c["direction"].alias("direction"), c["improved"].alias("improved"))


@query
def comparison_summary(spark, sf_dir):
    """How many metrics compare and improve, over pairs of customers' score means."""
    orders = table(spark, sf_dir, "orders")
    run = lambda shift: orders.groupBy((F.col("o_custkey") % 500).cast("string").alias("metric"), (F.col("o_custkey") % 2 == 0).alias("higher")).agg(F.round(F.avg(((F.col("o_orderkey") * shift) % 101) / 100.0), 6).alias("value"))
    return compare.comparison_summary(compare.compare_metrics(run(3), run(7).where("metric <> '7'")))


@query
def summarize_labels(spark, sf_dir):
    rows = truth(spark, sf_dir).select(F.struct(F.col("label").alias("fake_cls"), "target").alias("meta"))
    return convert.summarize(rows).select(F.coalesce("label", F.lit("*")).alias("label"), F.coalesce("verdict", F.lit("*")).alias("verdict"), "n")


@query
def label_auc(spark, sf_dir):
    """Flagship: area under the curve of document length as a score of quality or toxicity labels."""
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return metrics.auc(labelled.select(bad.alias("label"), F.col("n_chars").cast("double").alias("score"))).select(r6("auc").alias("auc"))
