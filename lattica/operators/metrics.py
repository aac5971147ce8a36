"""Classification and grounding metrics.

Sums over an order (ROC curves, precision at a rank) never run in one task: rows are summed
by distinct score first, and ``scan.running_sums`` deals these sums to ranges of scores, whose
number follows the data. The sums by score are written, so rows are computed once.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import bbox_iou, f1, safe_div, same_set, token_counts
from ..functions.scoring import binary_score, error_tags, hallucinated, type_scores
from ..functions.text import count_words
from ..storage import materialise
from ..types import TYPE_ORDER
from .scan import running_sums

#: Rows of one tied score whose order is looked at together.
TIE_ROWS = 1 << 20
#: Words whose sub-words a worker counts once.
KNOWN_WORDS = 200_000


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    one = F.col(label).cast("long")
    return materialise(df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg")), "by_score")


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: area under the ROC curve, ties counting half; NaN without both classes."""
    rows = running_sums(_by_score(df, label, score), [], [F.col("score")], ["neg"])
    below = F.col("neg_upto") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    area = F.sum("pos").cast("double") * F.sum("neg")
    return rows.agg(F.when(area > 0, wins / area).otherwise(F.lit(float("nan"))).alias("auc"))


def score_sketch(df: DataFrame, label: str = "label", score: str = "score", bins: int = 1024) -> DataFrame:
    """bin, pos, neg: counts by class over equal parts of [0, 1], for tables and streams alike.

    Sketches merge by adding counts, in any order (``merge_sketches``); a stream keeps one as its
    state. Scores below 0 and above 1 fall into the outer bins, null and NaN ones and null labels nowhere.
    """
    s, one = F.col(score).cast("double"), F.col(label).cast("long")
    place = F.least(F.greatest(F.floor(s * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = df.where(s.isNotNull() & ~F.isnan(s) & one.isNotNull())
    return rows.groupBy(place.alias("bin")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sketch_auc(sketch: DataFrame) -> DataFrame:
    """One row: auc, and the largest error it can have against that of the scores; NaN without both classes.

    Pairs of different bins are ordered as their scores are. A pair of one bin counts a half, and
    may count anything from 0 to 1, so the error is at most half of such pairs' share.
    """
    below = F.coalesce(F.sum("neg").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # of the bins
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    wins, within = F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)), F.sum(F.col("pos") * F.col("neg")) / 2.0
    share = lambda c: F.when(pairs > 0, c / pairs).otherwise(F.lit(float("nan")))
    return sketch.withColumn("_below", below).agg(share(wins).alias("auc"), share(within).alias("error"))


def eer(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: rate at which false acceptance and rejection meet, interpolated; NaN without both classes."""
    by = _by_score(df, label, score)
    total = by.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = total["p"] or 0, total["n"] or 0
    if not p or not n:
        return df.sparkSession.range(1).select(F.lit(float("nan")).alias("eer"))
    rows = running_sums(by, [], [F.col("score").desc()], ["pos", "neg"])
    fpr, tpr = F.col("neg_upto") / n, F.col("pos_upto") / p
    fpr0, tpr0 = (F.col("neg_upto") - F.col("neg")) / n, (F.col("pos_upto") - F.col("pos")) / p
    a, b = (1.0 - tpr0) - fpr0, (1.0 - tpr) - fpr
    share = F.when(a - b != 0, a / (a - b)).otherwise(F.lit(0.0))
    crossed = rows.select(fpr.alias("fpr"), tpr.alias("tpr"), (fpr0 + share * (fpr - fpr0)).alias("at"), (a * b).alias("sign")).where("sign <= 0")
    return crossed.agg(F.coalesce(F.min_by("at", F.struct("fpr", "tpr")), F.lit(1.0)).alias("eer"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", order: str = "ord", by: list[str] | None = None) -> DataFrame:
    """A row per group: mean precision at the ranks of positives, ties in the order of ``order``; NaN without any."""
    by = by or []
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("hit"), F.col(order).alias("ord"))
    rows = materialise(rows.withColumn("chunk", F.floor(F.col("ord") / TIE_ROWS)), "ranked")
    sums = materialise(rows.groupBy(*by, "score", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")), "sums")
    sums = running_sums(sums, by, [F.col("score").desc(), F.col("chunk")], ["n", "hits"])
    base = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("score").alias("_s"), F.col("chunk").alias("_c"), (F.col("n_upto") - F.col("n")).alias("_n"), (F.col("hits_upto") - F.col("hits")).alias("_h"))
    w = W.partitionBy(*by, "score", "chunk").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({"r": F.count(F.lit(1)).over(w), "h": F.sum("hit").over(w)})
    on = (F.col("score") == F.col("_s")) & (F.col("chunk") == F.col("_c"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    at = local.join(base, on).withColumn("precision", (F.col("h") + F.col("_h")) / (F.col("r") + F.col("_n")))
    mean = F.avg(F.when(F.col("hit") == 1, F.col("precision")))
    return (at.groupBy(*by) if by else at).agg(F.coalesce(mean, F.lit(float("nan"))).alias("ap"))


def mean_average_precision(aps: DataFrame) -> DataFrame:
    return aps.agg(F.coalesce(F.avg(F.when(~F.isnan("ap"), F.col("ap"))), F.lit(float("nan"))).alias("map"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row of tp, tn, fp, fn; a null prediction is wrong for either class."""
    y, p = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p.isNull() | (p == 1)) & (y == 0)).alias("fp"), F.count_if((p.isNull() | (p == 0)) & (y == 1)).alias("fn"),
    )


def rates(df: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1, fpr, fnr to tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return df.withColumns({"accuracy": safe_div(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": f1(precision, recall), "fpr": safe_div(fp, fp + tn), "fnr": safe_div(fn, fn + tp)})


def per_class(df: DataFrame, by: str = "type", label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each class."""
    y, p = F.col(label), F.col(predicted)
    sums = df.groupBy(by).agg(F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 1)).alias("fn"))
    precision, recall = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": precision, "recall": recall, "f1": f1(precision, recall)})


def micro_macro(classes: DataFrame) -> DataFrame:
    """One row: op, or, of1 over all classes together, cp, cr, cf1 over their means."""
    op = safe_div(F.sum("tp"), F.sum(F.col("tp") + F.col("fp")))
    recall = safe_div(F.sum("tp"), F.sum(F.col("tp") + F.col("fn")))
    sums = classes.agg(op.alias("op"), recall.alias("or"), F.avg("precision").alias("cp"), F.avg("recall").alias("cr"))
    return sums.withColumns({"of1": f1(F.col("op"), F.col("or")), "cf1": f1(F.col("cp"), F.col("cr"))})


def by_type(df: DataFrame, target: Column, scores: Column, given: Column, parsed_types: Column, threshold: float = 0.5) -> DataFrame:
    """A row per type: label, score and predicted."""
    at = lambda i, t: F.struct(
        F.lit(t).alias("type"), F.array_contains(target["types"], t).cast("int").alias("label"), F.get(scores, F.lit(i)).alias("score"),
        F.when(given, (F.get(scores, F.lit(i)) >= threshold).cast("int")).otherwise(F.coalesce(F.array_contains(parsed_types, t), F.lit(False)).cast("int")).alias("predicted"),
    )
    return df.select("ord", F.inline(F.array(*[at(i, t) for i, t in enumerate(TYPE_ORDER)])))


def score_rows(aligned: DataFrame, *, bbox_threshold: float = 0.5, text_f1_threshold: float = 1.0, binary_threshold: float = 0.5, type_threshold: float = 0.5) -> DataFrame:
    """From target, parsed, caption, manipulated_score, type_scores (a map): what the metrics are sums of.

    ``type_list``, if there is such a column, has the scores of rows that list four of them.
    """
    target, parsed = F.col("target"), F.col("parsed")
    df = aligned.withColumns({"_binary": binary_score(F.col("manipulated_score"), parsed), "_types": type_scores(F.col("type_scores"), parsed, F.col("type_list") if "type_list" in aligned.columns else None)})
    predicted = F.when(F.col("_binary.given"), (F.col("_binary.score") >= binary_threshold).cast("int")).when(parsed["valid"], (parsed["verdict"] == "manipulated").cast("int"))
    words = token_counts(target["text_positions"], F.coalesce(parsed["text_positions"], F.array().cast("array<int>")), count_words(F.col("caption")))
    return df.withColumns({
        "label": (target["verdict"] == "manipulated").cast("int"), "score": F.col("_binary.score"), "has_score": F.col("_binary.given"), "predicted": predicted,
        "type_vector": F.col("_types.scores"), "has_types": F.col("_types.given"), "iou": F.when(parsed["valid"], bbox_iou(target["image_bbox"], parsed["image_bbox"])).otherwise(F.lit(0.0)),
        "words": words, "hallucinated": hallucinated(target, parsed), "errors": error_tags(target, parsed, bbox_threshold, text_f1_threshold),
    }).drop("_binary", "_types")


def tag_counts(df: DataFrame, errors: str = "errors") -> DataFrame:
    return df.select(F.explode(errors).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def grounding(scored: DataFrame) -> DataFrame:
    """One row of all metrics that are plain sums over rows."""
    rate = lambda c, name: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(name)
    target, parsed, iou = F.col("target"), F.col("parsed"), F.col("iou")
    exact = same_set(parsed["types"], target["types"])
    return scored.agg(
        F.count(F.lit(1)).alias("num_samples"), rate(parsed["valid"], "json_valid_rate"), rate(parsed["valid"] & (parsed["verdict"] == target["verdict"]), "verdict_accuracy"), rate(parsed["valid"] & exact, "types_exact_match"),
        rate(iou, "mean_iou"), rate(iou > 0.5, "iou_at_50"), rate(iou > 0.75, "iou_at_75"), rate(iou > 0.95, "iou_at_95"),
        *[F.coalesce(F.sum(f"words.{c}"), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")], F.count_if(F.size("errors") > 0).alias("badcase_count"), rate(F.size("errors") > 0, "badcase_rate"),
        rate(F.col("hallucinated"), "evidence_hallucination_rate"), F.coalesce(F.bool_and("has_score"), F.lit(True)).alias("all_scores"), F.coalesce(F.bool_and("has_types"), F.lit(True)).alias("all_types"),
    )


def official_percent(binary: dict, multi: dict, image: dict, text: dict) -> dict[str, float]:
    """The 22 headline metrics, in percent."""
    f1s = multi["per_class_f1"]
    parts = {
        "AUC_cls": binary["auc"], "ACC_cls": binary["accuracy"], "EER_cls": binary["eer"], "MAP": multi["map"], "OP": multi["op"], "OR": multi["or"], "OF1": multi["of1"], "CP": multi["cp"], "CR": multi["cr"], "CF1": multi["cf1"],
        "F1_FS": f1s["face_swap"], "F1_FA": f1s["face_attribute"], "F1_TS": f1s["text_swap"], "F1_TA": f1s["text_attribute"], "IOU_score": image["mean_iou"], "IOU_ACC_50": image["iou_at_50"], "IOU_ACC_75": image["iou_at_75"], "IOU_ACC_95": image["iou_at_95"],
        "ACC_tok": text["accuracy"], "Precision_tok": text["precision"], "Recall_tok": text["recall"], "F1_tok": text["f1"],
    }
    return {k: v * 100.0 for k, v in parts.items()}


def evaluate(scored: DataFrame, *, type_threshold: float = 0.5, binary_threshold: float = 0.5, subwords: DataFrame | None = None, subword_name: str = "subword", max_length: int = 128) -> dict[str, Any]:
    """The metrics tree. ``scored`` comes from score_rows and should be cached or written: four aggregates read it.

    ``subwords``, of tp, tn, fp and fn by row, adds the sub-word level.
    """
    sums = grounding(scored).first().asDict()
    if not sums["num_samples"]:
        raise ValueError("ground truth is empty")
    cells = ["tp", "tn", "fp", "fn"]
    mode = lambda every: "continuous" if every else "discrete_or_mixed_fallback"
    binary = rates(confusion(scored)).first().asDict()
    binary |= {"auc": auc(scored).first()[0], "eer": eer(scored).first()[0], "score_mode": mode(sums["all_scores"])}
    typed = by_type(scored, F.col("target"), F.col("type_vector"), F.col("has_types"), F.col("parsed.types"), type_threshold)
    classes = per_class(typed)
    aps = {r["type"]: r["ap"] for r in average_precision(typed, by=["type"]).collect()}  # four rows
    finite = [v for v in aps.values() if v == v]
    multi: dict[str, Any] = {"map": sum(finite) / len(finite) if finite else float("nan")} | micro_macro(classes).first().asDict()
    multi |= {"per_class_ap": {t: aps.get(t, float("nan")) for t in TYPE_ORDER}, "per_class_f1": {r["type"]: r["f1"] for r in classes.collect()}, "score_mode": mode(sums["all_types"])}
    word = rates(scored.agg(*[F.coalesce(F.sum(f"words.{c}"), F.lit(0)).alias(c) for c in cells])).first().asDict()
    text: dict[str, Any] = {"word_level": word}
    if subwords is not None:
        text["official_bert_token_level"] = rates(subwords.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cells])).first().asDict() | {"tokenizer": subword_name, "max_length": max_length}
    image = {k: sums[k] for k in ("mean_iou", "iou_at_50", "iou_at_75", "iou_at_95")}
    headline = text.get("official_bert_token_level", word)
    return {
        "num_samples": sums["num_samples"], "json_valid_rate": sums["json_valid_rate"], "official_metrics_percent": official_percent(binary, multi, image, headline),
        "structured_output": {k: sums[k] for k in ("verdict_accuracy", "types_exact_match")}, "binary_classification": binary, "multilabel_classification": multi, "image_grounding": image, "text_grounding": text,
        "badcase_analysis": {"badcase_count": sums["badcase_count"], "badcase_rate": sums["badcase_rate"], "error_tag_counts": {r["tag"]: r["n"] for r in tag_counts(scored).orderBy("tag").collect()}, "evidence_hallucination_rate": sums["evidence_hallucination_rate"]},
        "notes": {"thresholds": {"binary": binary_threshold, "type": type_threshold}, "text_source": "bert_subword" if subwords is not None else "word_level_fallback"},
    }


def bad_cases(scored: DataFrame) -> DataFrame:
    """Rows with an error, for a JSON lines sink."""
    return scored.where(F.size("errors") > 0).select("id", "errors", "target", "response", *(["meta"] if "meta" in scored.columns else []))


def word_numbers(tokenizer: str):
    """The word number of each sub-word, by a file of the tokenizers library; made once in each worker.

    The library encodes words that are given as a list one by one, so how many sub-words a word has
    is remembered, unless the file cuts or pads texts or leaves out merges by chance.
    """
    made: list = []

    def by_library(words: list[str]) -> list[int]:
        return [w for w in made[0].encode(words, is_pretokenized=True, add_special_tokens=False).word_ids if w is not None]

    def numbers(text: str) -> list[int]:
        if not made:
            from tokenizers import Tokenizer

            made.append(Tokenizer.from_file(tokenizer))
            made.append({} if made[0].truncation is made[0].padding is getattr(made[0].model, "dropout", None) is None else None)
        words, sizes = text.split(), made[1]
        if not words or sizes is None:
            return by_library(words) if words else []
        if unknown := [w for w in dict.fromkeys(words) if w not in sizes]:
            if len(sizes) > KNOWN_WORDS:
                sizes.clear()
                unknown = list(dict.fromkeys(words))
            counts = Counter(by_library(unknown))
            sizes.update((w, counts[i]) for i, w in enumerate(unknown))
        return [i for i, w in enumerate(words) for _ in range(sizes[w])]

    return numbers


def subword_counts(df: DataFrame, tokenize, caption: str = "caption", max_length: int = 128) -> DataFrame:
    """tp, tn, fp, fn of each row at the level of sub-words.

    ``tokenize(text)`` gives the word number of each sub-word; the first max_length - 2 count.
    """
    @F.arrow_udf("n int, of array<int>")
    def words(texts: pa.Array) -> pa.Array:
        sizes, ns = [], []
        for text in texts.to_pylist():
            found = list(tokenize(text or ""))[: max_length - 2]
            of = [0] * (max(found, default=-1) + 1)
            for w in found:
                of[w] += 1
            sizes.append(of)
            ns.append(len(found))
        return pa.StructArray.from_arrays([pa.array(ns, pa.int32()), pa.array(sizes, pa.list_(pa.int32()))], ["n", "of"])

    # sub-words of a word are all in a set of words or none is, so sums over words in the sets are what counts
    within = lambda xs: F.aggregate(xs, F.lit(0), lambda n, w: n + F.coalesce(F.get("_w.of", w), F.lit(0)))
    a, b = (F.coalesce(F.col(f"{side}.text_positions"), F.array().cast("array<int>")) for side in ("target", "parsed"))
    sums = {"both": within(F.array_intersect(a, b)), "a": within(F.array_distinct(a)), "b": within(F.array_distinct(b))}
    rows = df.withColumn("_w", words(F.col(caption))).select("_w.n", *[c.alias(n) for n, c in sums.items()])
    return rows.select(F.col("both").alias("tp"), (F.col("n") - F.col("a") - F.col("b") + F.col("both")).alias("tn"), (F.col("b") - F.col("both")).alias("fp"), (F.col("a") - F.col("both")).alias("fn"))
