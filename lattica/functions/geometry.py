"""Boxes, sets and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind_all


def safe_div(top: Column, below: Column) -> Column:
    return F.when(below != 0, top / below).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return safe_div(2 * precision * recall, precision + recall)


def _side(lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), hi - lo)


def bbox_iou(a: Column, b: Column) -> Column:
    """Two missing boxes agree, one doesn't; boxes without area between them agree."""
    ax, ay, aw, ah = (F.get(a, F.lit(i)).cast("double") for i in range(4))
    bx, by, bw, bh = (F.get(b, F.lit(i)).cast("double") for i in range(4))
    common = _side(F.greatest(ax, bx), F.least(aw, bw)) * _side(F.greatest(ay, by), F.least(ah, bh))
    areas = _side(ax, aw) * _side(ay, ah) + _side(bx, bw) * _side(by, bh)

    def share(s: Column) -> Column:
        union = s["areas"] - s["common"]
        return F.when(union <= 0, F.lit(1.0)).otherwise(s["common"] / union)

    both = bind_all({"common": common, "areas": areas}, share)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(both)


def set_f1(expected: Column, predicted: Column) -> Column:
    def of(s: Column) -> Column:
        both = bind_all({"precision": safe_div(s["hits"], s["b"]), "recall": safe_div(s["hits"], s["a"])}, lambda r: f1(r["precision"], r["recall"]))
        return F.when((s["a"] == 0) & (s["b"] == 0), F.lit(1.0)).otherwise(both)

    a, b = F.array_distinct(expected), F.array_distinct(predicted)
    return bind_all({"a": F.size(a), "b": F.size(b), "hits": F.size(F.array_intersect(expected, predicted))}, of)


def bbox_area_ratio(bbox: Column, scale: float = 1000.0) -> Column:
    x1, y1, x2, y2 = (F.get(bbox, F.lit(i)).cast("double") for i in range(4))
    return F.when(bbox.isNull(), F.lit(0.0)).otherwise(_side(x1, x2) * _side(y1, y2) / (scale * scale))


def same_set(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def clamp(value: Column) -> Column:
    """Into [0, 1]; NaN is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(value.cast("double"), F.lit(0.0))))


def token_counts(expected: Column, predicted: Column, n: Column) -> Column:
    """struct<tp, tn, fp, fn> of two position sets among n tokens."""
    def cells(s: Column) -> Column:
        tp, fp, fn = s["both"], s["b"] - s["both"], s["a"] - s["both"]
        return F.struct(tp.alias("tp"), (s["n"] - tp - fp - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"))

    def sizes(s: Column) -> Column:
        return bind_all({"n": s["n"], "both": F.size(F.array_intersect(s["a"], s["b"])), "a": F.size(s["a"]), "b": F.size(s["b"])}, cells)

    def within(s: Column) -> Column:
        inside = lambda xs: F.array_distinct(F.filter(xs, lambda x: (x >= 0) & (x < s["n"])))
        return bind_all({"n": s["n"], "a": inside(expected), "b": inside(predicted)}, sizes)

    return bind_all({"n": n}, within)
