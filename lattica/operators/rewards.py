"""Rewards of responses, weighted by how rare a case is."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import case_name
from ..functions.scoring import score_response
from ..types import IMAGE_TYPES, TEXT_TYPES, TYPE_ORDER, RewardRules


def count_cases(df: DataFrame, target: str = "target") -> DataFrame:
    """case and n; each row's target, or else its meta's, must be there."""
    fields = {f.name: f.dataType for f in df.schema}
    places = [F.col(target)] * (target in fields) + [F.col("meta.target")] * ("target" in getattr(fields.get("meta"), "names", []))
    if not places:
        raise ValueError("records have neither target nor meta.target")
    there = F.coalesce(*places)
    missing = F.raise_error(F.lit("a record has neither target nor meta.target")).cast("string")
    return df.groupBy(F.when(there.isNull(), missing).otherwise(case_name(there)).alias("case")).agg(F.count(F.lit(1)).alias("n"))


def case_weights(counts: DataFrame, rules: RewardRules = RewardRules()) -> DataFrame:
    """case, n, weight: the root of median over count, clipped; no counts at all are an error. At most eight cases have any."""
    least, most = rules.case_weights
    some = counts.where("n > 0").agg(F.collect_list(F.struct("case", "n")).alias("_all"), F.median("n").alias("_m"))
    none = F.raise_error(F.lit("no case has a count")).cast(some.schema["_all"].dataType)
    rows = some.select("_m", F.inline(F.when(F.size("_all") == 0, none).otherwise(F.col("_all"))))
    return rows.select("case", "n", F.least(F.lit(most), F.greatest(F.lit(least), F.sqrt(F.col("_m") / F.col("n")))).alias("weight"))


def score_rewards(aligned: DataFrame, weights: DataFrame | None = None, rules: RewardRules = RewardRules()) -> DataFrame:
    """id, reward, breakdown and target of rows with target and parsed; cases without a weight count 1."""
    df = aligned.withColumn("_case", case_name(F.col("target")))
    if weights is not None:
        table = weights.select(F.col("case").alias("_wc"), F.col("weight").alias("_w"))
        df = df.join(F.broadcast(table), F.col("_case") == F.col("_wc"), "left")  # a row for each of eight cases
    else:
        df = df.withColumn("_w", F.lit(None).cast("double"))
    breakdown = score_response(F.col("target"), F.col("parsed"), F.coalesce("_w", F.lit(1.0)), rules)
    return df.withColumn("breakdown", breakdown).select("id", F.col("breakdown.reward").alias("reward"), "breakdown", "target")


def reward_summary(scored: DataFrame) -> DataFrame:
    """One row; zeros when there are no rows."""
    b = F.col("breakdown")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return scored.agg(F.count(F.lit(1)).alias("count"), zero(F.avg("reward"), "mean_reward"), zero(F.min("reward"), "min_reward"), zero(F.max("reward"), "max_reward"), zero(F.avg(b["penalty"]), "mean_penalty"), zero(F.avg(b["valid"].cast("double")), "valid_rate"))


# The same reward as a plain callable, for trainers that call it in their own processes.


def completion_text(completion: Any) -> Any:
    """The text in a completion: itself, a message's content, or that of the first message."""
    while isinstance(completion, list) and completion:
        completion = completion[0]
    if isinstance(completion, dict):
        for key in ("content", "response", "text"):
            if key in completion:
                return completion[key]
        return ""
    return completion if isinstance(completion, str) else str(completion)


def spread_targets(targets: Any, count: int) -> list[dict[str, Any]]:
    """One target for each completion: one for all, or each for equally many in a row."""
    if isinstance(targets, dict):
        return [targets] * count
    if targets is None:
        raise ValueError("the reward needs a target, or meta with one")
    each, rest = divmod(count, len(targets)) if targets else (0, 1)
    if rest or not each and count:
        raise ValueError(f"{len(targets)} targets for {count} completions")
    return [t for t in targets for _ in range(each)]


def _iou(a, b) -> float:
    if a is None or b is None:
        return float(a is b)
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    common = area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
    both = area(a) + area(b) - common
    return common / both if both > 0 else 1.0


def _set_f1(a, b) -> float:
    a, b = set(a), set(b)
    if not a and not b:
        return 1.0
    hits = len(a & b)
    return 2 * hits / (len(a) + len(b))


def reward_of(target: dict[str, Any], response: Any, weights: dict[str, float] | None = None, rules: RewardRules = RewardRules()) -> float:
    """Reward of one response; agrees with score_response()."""
    from ..functions.parse import parse_one

    valid, verdict, types, box, words, _ = parse_one(response, rules.max_words)
    if not valid:
        return -rules.most_fined
    wanted, pristine = set(target["types"]), target["verdict"] == "pristine"
    image, text = wanted & set(IMAGE_TYPES), wanted & set(TEXT_TYPES)
    if target["verdict"] != "manipulated" or not wanted:
        case = "normal"
    elif image and text:
        case = "image_text_mixed"
    else:
        case = next(iter(wanted)) if len(wanted) == 1 else "image_mixed" if image else "text_mixed"
    found = [_iou(target.get("image_bbox"), box)] * bool(image) + [_set_f1(target.get("text_positions", []), words)] * bool(text)
    parts = {
        "verdict": 1.0 if verdict == target["verdict"] else -0.5 if pristine else -1.0,
        "types": 1.0 if pristine and not types else _set_f1(wanted, types),
        "evidence": float(box is None and not words) if pristine else sum(found) / len(found) if found else 0.0,
    }
    share = {"whole_image": 0.0 if box is None else max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1]) / 1e6, "whole_text": len(words) / max(1, rules.max_words)}
    shown = {"false_alarm": pristine and verdict == "manipulated", "every_type": set(types) == set(TYPE_ORDER)}
    fined = sum(f.cost for f in rules.fines if (shown[f.habit] if f.habit in shown else share[f.habit] >= f.share))
    return (weights or {}).get(case, 1.0) * sum(rules.parts[k] * v for k, v in parts.items()) - min(rules.most_fined, fined)


def make_reward(weights: dict[str, float] | None = None, rules: RewardRules = RewardRules()) -> Callable[..., list[float]]:
    """A trainer's callback: completions, and target or meta, to rewards."""

    def reward(completions: list[Any], **columns: Any) -> list[float]:
        targets = columns.get("target")
        if targets is None and columns.get("meta") is not None:
            targets = [m["target"] for m in columns["meta"]]
        return [reward_of(t, completion_text(c), weights, rules) for t, c in zip(spread_targets(targets, len(completions)), completions)]

    return reward
