"""Errors, scores and rewards of parsed responses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import IMAGE_TYPES, RESPONSE_KEYS, TEXT_TYPES, TYPE_ORDER, RewardRules
from .bind import bind, bind_all
from .geometry import bbox_area_ratio, bbox_iou, clamp, same_set, set_f1
from .labels import case_name, has_any, strings


def error_tags(target: Column, parsed: Column, bbox_threshold: float = 0.5, text_f1_threshold: float = 1.0) -> Column:
    """Sorted tags of what is wrong; an invalid response has one only."""
    tag = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array(
        tag(parsed["verdict"] != target["verdict"], "wrong_verdict"),
        tag(~same_set(parsed["types"], target["types"]), "wrong_types"),
        tag(bbox_iou(target["image_bbox"], parsed["image_bbox"]) < bbox_threshold, "image_grounding"),
        tag(set_f1(target["text_positions"], parsed["text_positions"]) < text_f1_threshold, "text_grounding"),
        tag(target["image_bbox"].isNull() & parsed["image_bbox"].isNotNull(), "hallucinated_image_evidence"),
        tag((F.size(target["text_positions"]) == 0) & (F.size(parsed["text_positions"]) > 0), "hallucinated_text_evidence"),
    )
    return F.when(~parsed["valid"], strings(["invalid_json_or_schema"])).otherwise(F.sort_array(F.array_compact(found)))


def hallucinated(target: Column, parsed: Column) -> Column:
    """Evidence that no expected type calls for."""
    image = ~has_any(target["types"], IMAGE_TYPES) & parsed["image_bbox"].isNotNull()
    text = ~has_any(target["types"], TEXT_TYPES) & (F.size(parsed["text_positions"]) > 0)
    return parsed["valid"] & (image | text)


def binary_score(scores: Column, parsed: Column) -> Column:
    """struct<score, given>: the score of a row, else 1, 0 or 0.5 by its verdict."""
    by_verdict = F.when(parsed["verdict"] == "manipulated", 1.0).when(parsed["verdict"] == "pristine", 0.0).otherwise(0.5)
    return F.struct(F.when(scores.isNotNull(), clamp(scores)).otherwise(by_verdict).alias("score"), scores.isNotNull().alias("given"))


def type_scores(named: Column, parsed: Column, listed: Column | None = None) -> Column:
    """struct<scores array<double>, given>: from a map by type, or a list of four, else 0 or 1 by the parsed types."""
    by_name = F.transform(strings(TYPE_ORDER), lambda t: clamp(F.coalesce(F.try_element_at(named, t), F.lit(0.0))))
    by_type = F.transform(strings(TYPE_ORDER), lambda t: F.coalesce(F.array_contains(parsed["types"], t), F.lit(False)).cast("double"))
    four = F.lit(False) if listed is None else F.coalesce(F.size(listed) == 4, F.lit(False))
    by_place = by_type if listed is None else F.transform(listed, clamp)
    return F.struct(F.when(named.isNotNull(), by_name).when(four, by_place).otherwise(by_type).alias("scores"), (named.isNotNull() | four).alias("given"))


def candidate_score(negative: Column, positive: Column) -> Column:
    """Softmax of two mean log-probabilities."""
    top = F.greatest(negative, positive)
    return F.exp(positive - top) / (F.exp(negative - top) + F.exp(positive - top))


def first_present(raw: Column, names: tuple[str, ...], of) -> Column:
    """``of(name)`` for the first of the names that a JSON object has, be it with a null; null if it has none."""
    keys, out = F.json_object_keys(raw), None
    for name in names:
        has = F.array_contains(keys, name)
        out = F.when(has, of(name)) if out is None else out.when(has, of(name))
    return out


def response_text(raw: Column) -> Column:
    """The first response field of a prediction, given as its JSON: a null there is the text ``None``, and no such field an error."""
    found = first_present(raw, RESPONSE_KEYS, lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit("None")))
    return F.coalesce(found, F.raise_error(F.lit(f"a prediction has none of {RESPONSE_KEYS}")).cast("string"))


def given_type_scores(raw: Column) -> tuple[Column, Column]:
    """type_scores of a prediction's JSON as a map and as a list; one is null, or both."""
    text = F.get_json_object(raw, "$.type_scores")
    of = lambda kind, schema: bind(text, lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).startswith(kind), F.from_json(t, schema)))
    return of("OBJECT", "map<string,double>"), of("ARRAY", "array<double>")


def row_id(columns: list[str]) -> Column:
    """id, else meta.id, as text."""
    found = [F.col(c) for c, has in (("id", "id" in columns), ("meta.id", "meta" in columns)) if has]
    return F.coalesce(*[c.cast("string") for c in found]) if found else F.lit(None).cast("string")


def rejected_text(response: Column) -> Column:
    """What a preference pair rejects: the trimmed response, or an empty object."""
    from .text import strip_blanks

    text = strip_blanks(F.coalesce(response, F.lit("None")))
    return F.when(text == "", "{}").otherwise(text)


def evidence_reward(target: Column, parsed: Column) -> Column:
    image, text = has_any(target["types"], IMAGE_TYPES), has_any(target["types"], TEXT_TYPES)
    none = parsed["image_bbox"].isNull() & (F.size(parsed["text_positions"]) == 0)

    def of(s: Column) -> Column:
        return F.when(target["verdict"] == "pristine", none.cast("double")).when(image & text, (s["iou"] + s["words"]) / 2).when(image, s["iou"]).when(text, s["words"]).otherwise(F.lit(0.0))

    return bind_all({"iou": bbox_iou(target["image_bbox"], parsed["image_bbox"]), "words": set_f1(target["text_positions"], parsed["text_positions"])}, of)


def hacking_penalty(target: Column, parsed: Column, rules: RewardRules = RewardRules()) -> Column:
    """Fines for habits that win rewards without an answer, at most ``most_fined``, which an invalid response costs."""
    share = {"whole_image": bbox_area_ratio(parsed["image_bbox"]), "whole_text": F.size(parsed["text_positions"]) / max(1, rules.max_words)}
    shown = {"false_alarm": (target["verdict"] == "pristine") & (parsed["verdict"] == "manipulated"), "every_type": same_set(parsed["types"], strings(TYPE_ORDER))}
    total = F.lit(0.0)
    for fine in rules.fines:
        total = total + F.when(shown[fine.habit] if fine.habit in shown else share[fine.habit] >= fine.share, F.lit(fine.cost)).otherwise(F.lit(0.0))
    return F.when(parsed["valid"], F.least(F.lit(rules.most_fined), total)).otherwise(F.lit(rules.most_fined))


def score_response(target: Column, parsed: Column, case_weight: Column, rules: RewardRules = RewardRules()) -> Column:
    """The reward and its parts."""
    ok, pristine = parsed["valid"], target["verdict"] == "pristine"
    parts = {
        "verdict": F.when(parsed["verdict"] == target["verdict"], 1.0).when(target["verdict"] == "manipulated", -1.0).otherwise(-0.5),
        "types": F.when(pristine & (F.size(parsed["types"]) == 0), F.lit(1.0)).otherwise(set_f1(target["types"], parsed["types"])),
        "evidence": evidence_reward(target, parsed),
    }

    def of(s: Column) -> Column:
        task = F.lit(0.0)
        for name in parts:
            task = task + rules.parts[name] * s[name]
        part = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
        return F.struct(
            F.when(ok, case_weight * task - s["penalty"]).otherwise(F.lit(-rules.most_fined)).alias("reward"), case_name(target).alias("case"), case_weight.alias("case_weight"), part(task).alias("task_reward"), part(s["verdict"]).alias("verdict_reward"),
            part(s["types"]).alias("type_reward"), part(s["evidence"]).alias("evidence_reward"), s["penalty"].alias("penalty"), ok.alias("valid"), parsed["error"].alias("error"),
        )

    return bind_all(parts | {"penalty": hacking_penalty(target, parsed, rules)}, of)


def compare_values(before: Column, after: Column, higher: Column) -> Column:
    """Change of a metric; relative_error_reduction is null where no error was left."""
    delta = after - before
    left = F.when(higher, 1.0 - before).otherwise(before)
    return F.struct(
        before.alias("before"), after.alias("after"), delta.alias("absolute_delta"), F.when(higher, "higher").otherwise("lower").alias("direction"),
        F.when(higher, delta > 0).otherwise(delta < 0).alias("improved"), F.when(left > 0, F.when(higher, delta).otherwise(-delta) / left).alias("relative_error_reduction"),
    )
