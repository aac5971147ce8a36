"""Labels, boxes and canonical targets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import IMAGE_TYPES, MAX_WORDS, TEXT_TYPES, TYPE_ALIASES, TYPE_ORDER
from .bind import bind
from .text import strip_blanks


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def in_type_order(names: Column) -> Column:
    return F.filter(strings(TYPE_ORDER), lambda t: F.array_contains(names, t))


def label_to_types(label: Column) -> Column:
    """Types of a label such as ``fs&text_swap``, in order; ``orig`` has none; unknown names raise."""
    known = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    of = lambda raw: F.coalesce(F.try_element_at(known, raw), F.try_element_at(known, F.lower(strip_blanks(raw))), F.raise_error(F.concat(F.lit("unknown manipulation label: "), raw)).cast("string"))
    return F.when(label == "orig", strings([])).otherwise(F.coalesce(F.array_intersect(strings(TYPE_ORDER), F.transform(F.split(label, "&", -1), of)), strings([])))


def has_any(types: Column, of) -> Column:
    return F.arrays_overlap(types, strings(of))


def normalize_bbox(bbox: Column, width: Column, height: Column, scale: int = 1000) -> Column:
    """Coordinates as half-even rounded thousandths of the image; null and empty boxes are null."""
    side = lambda v, i: F.rint(F.least(F.lit(float(scale)), F.greatest(F.lit(0.0), v / F.when(i % 2 == 0, width).otherwise(height) * scale))).cast("int")
    wrong = (F.size(bbox) != 4) | (width <= 0) | (height <= 0)
    checked = F.when(wrong, F.raise_error(F.lit("a box needs four coordinates and a positive image size")).cast("array<int>")).otherwise(F.transform(bbox.cast("array<double>"), side))
    return F.when(bbox.isNull() | (F.size(bbox) == 0), F.lit(None).cast("array<int>")).otherwise(checked)


def build_target(label: Column, bbox: Column, positions: Column, width: Column, height: Column, max_words: int = MAX_WORDS) -> Column:
    """struct<verdict, types, image_bbox, text_positions>: evidence only where a type asks for it."""
    words = F.sort_array(F.array_distinct(F.filter(positions.cast("array<int>"), lambda p: (p >= 0) & (p < max_words))))
    box = normalize_bbox(bbox, width, height)

    def of(types: Column) -> Column:
        return F.struct(
            F.when(F.size(types) == 0, "pristine").otherwise("manipulated").alias("verdict"),
            types.alias("types"),
            F.when(has_any(types, IMAGE_TYPES), box).alias("image_bbox"),
            F.when(has_any(types, TEXT_TYPES), F.coalesce(words, F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("text_positions"),
        )

    return bind(label_to_types(label), of)


def canonical_answer(target: Column) -> Column:
    """Compact JSON in fixed key order."""
    parts = [target[n].alias(n) for n in ("verdict", "types", "image_bbox", "text_positions")]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def case_name(target: Column) -> Column:
    """normal, the only type, image_mixed, text_mixed or image_text_mixed."""
    types = F.coalesce(target["types"], strings([]))
    image, text = has_any(types, IMAGE_TYPES), has_any(types, TEXT_TYPES)
    plain = (~F.coalesce(target["verdict"] == "manipulated", F.lit(False))) | (F.size(types) == 0)
    only = F.size(F.array_distinct(types)) == 1
    return F.when(plain, "normal").when(image & text, "image_text_mixed").when(only, F.get(in_type_order(types), F.lit(0))).when(image, "image_mixed").when(text, "text_mixed").otherwise("normal")
