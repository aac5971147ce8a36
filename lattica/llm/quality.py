"""Quality rules: learned decision lists.

``text_statistics`` counts, in whole texts, what the rules need. ``learn_rules`` grows a
decision list from labelled statistics by sequential covering: a rule is a conjunction of
thresholds, grown on two thirds of what is left by information gain, pruned on the rest, and
kept while it is precise there; what it covers is removed before the next. ``verdict`` emits
the list as one ordered Spark conditional expression.

Learning takes at most ``max_labelled`` labelled documents, drawn by a hash of doc_id among
those that are there, and gives at most ``max_rules`` rules of ``max_conditions`` conditions,
whose thresholds are picked among ``cuts`` quantiles; the rules are applied to all texts.

Defined cases: null and empty texts have all statistics 0; no labels, or none of one class,
give an empty list, which keeps everything; null labels and labels without text teach
nothing; rows of one doc_id are one document to learn from, that of the least text; other
columns are kept: statistics get a prefix where they would clash (``prefix``), and else take
the place of columns named like them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bangs", "n_pipes", "n_same_next", "n_distinct")
#: name -> (statistic, what it is divided by); what the rules look at.
RATIOS = {"mean_word": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_words"), "repeat_rate": ("n_repeat_words", "n_words"), "upper_rate": ("n_upper", "n_letters"), "bang_rate": ("n_bangs", "n_words"), "pipe_rate": ("n_pipes", "n_words"), "same_next_rate": ("n_same_next", "n_words"), "distinct_rate": ("n_distinct", "n_words")}
#: Bytes that are looked at together; longer texts alone, and beyond LARGE word by word.
CHUNK, LARGE = 2 << 20, 16 << 20
WINDOW = 5

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _words(data: bytes) -> Iterator[bytes]:
    return iter(data.split()) if len(data) <= LARGE else (m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data))


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(flags, dtype=np.int64))
    return np.diff(upto[ends], prepend=0)


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen: set[bytes] = set()
    twice = 0
    for line in text.split(b"\n"):
        if line in seen:
            twice += not (not line or line.isspace())
        else:
            seen.add(line)
    return twice


def _repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each text in windows that it has twice or more."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = doc[at].astype(np.uint64)
        for i in range(WINDOW):
            key = (key ^ mixed[at + i]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    a, b = at[1:][same], at[:-1][same]
    equal = doc[a] == doc[b]
    for i in range(WINDOW):
        equal &= ids[a + i] == ids[b + i]
    if not equal.all():  # windows that differ share a hash: compare them all
        rows = np.stack([doc[at], *(ids[at + i] for i in range(WINDOW))], axis=1)
        _, inverse, n_of = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[n_of[inverse.ravel()] > 1]
    else:
        twice = np.concatenate([a, b])
    edge = np.zeros(len(ids) + 1, np.int64)
    twice = np.unique(twice)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row per text, a column per statistic."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    table: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(table.__getitem__, _words(t)), np.int64) for t in texts]
    n_words = np.array([len(i) for i in ids], np.int64)
    doc, flat = np.repeat(np.arange(len(texts)), n_words), np.concatenate(ids)
    next_same = np.zeros(len(flat), bool)
    next_same[1:] = (flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])
    pairs = np.unique(doc * np.int64(len(table) + 1) + flat)
    out = {
        "n_words": n_words, "word_chars": _sums((_FIRST & ~_BLANK)[data], ends), "n_symbols": _sums(_SYMBOL[data], ends), "n_dup_lines": [_dup_lines(t) for t in texts], "n_repeat_words": _repeats(flat, doc, len(texts)),
        "n_upper": _sums(_UPPER[data], ends), "n_letters": _sums(_LETTER[data], ends), "n_bangs": _sums(data == ord("!"), ends), "n_pipes": _sums(data == ord("|"), ends),
        "n_same_next": np.bincount(doc[next_same], minlength=len(texts)), "n_distinct": np.bincount(pairs // (len(table) + 1), minlength=len(texts)),
    }
    return np.stack([np.asarray(out[s], np.int64) for s in STATISTICS], axis=1)


def text_statistics(docs: DataFrame, text: str = "text", keep_text: bool = True, prefix: str = "") -> DataFrame:
    """Add the statistics of each whole text, their names after ``prefix``; they replace columns of these names in any case."""
    names = [prefix + s for s in STATISTICS]
    taken = {n.lower() for n in names}
    kept = [f for f in docs.schema if f.name.lower() not in taken and (keep_text or f.name.lower() != text.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, group, held = [], [], 0
            for v in batch.column(text):
                t = v.as_buffer().to_pybytes() if v.is_valid else b""
                if group and held + len(t) > CHUNK:
                    made.append(statistics(group))
                    group, held = [], 0
                group.append(t)
                held += len(t)
            if group:
                made.append(statistics(group))
            found = np.concatenate([np.zeros((0, len(STATISTICS)), np.int64), *made])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(c) for c in found.T)], [*(f.name for f in kept), *names])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in names)]))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.limit if self.above else values <= self.limit

    def column(self, prefix: str = "") -> Column:
        top, below = (prefix + s for s in RATIOS[self.name])
        ratio = F.when(F.col(below) > 0, F.col(top).cast("double") / F.col(below)).otherwise(F.lit(0.0))
        return ratio > self.limit if self.above else ratio <= self.limit


Rule = tuple[Condition, ...]


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x[:, names.index(c.name)])
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        inside = _covered(rule, x, names)
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0 or not n0:
            break
        best, pick = 1e-9, None
        for j, name in enumerate(names):
            values = x[inside, j]
            limits = np.unique(np.quantile(values, np.linspace(0, 1, cuts), method="lower"))
            limits = np.append((limits[1:] + limits[:-1]) / 2, limits)
            of_bad, of_good = np.sort(x[inside & bad, j]), np.sort(x[inside & ~bad, j])
            p, n = np.searchsorted(of_bad, limits, "right"), np.searchsorted(of_good, limits, "right")
            for above, gains in ((False, _gain(p0, n0, p, n)), (True, _gain(p0, n0, p0 - p, n0 - n))):
                k = int(np.argmax(gains))
                if gains[k] > best + 1e-9:
                    best, pick = gains[k], Condition(name, above, float(limits[k]))
        if pick is None:
            break
        rule += (pick,)
    return rule


def fit_rules(x: np.ndarray, bad: np.ndarray, names: list[str], *, max_rules: int = 24, max_conditions: int = 6, precision: float = 0.97, least: int = 3, cuts: int = 256, tries: int = 5, seed: int = 42) -> list[Rule]:
    """Ordered rules, each of which covers rows to reject. A rule that doesn't hold is grown anew on another draw, ``tries`` times in a row."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    rng = np.random.default_rng(seed)
    failed = 0
    while len(rules) < max_rules and failed < tries and (left & bad).sum() >= least:
        grow = left & (rng.random(len(x)) < 2 / 3)
        prune = left & ~grow
        rule = _grow(x[grow], bad[grow], names, cuts, max_conditions)
        if not rule:
            failed += 1
            continue

        def worth(r: Rule) -> tuple[float, int]:
            c = _covered(r, x[prune], names)
            p, n = (c & bad[prune]).sum(), (c & ~bad[prune]).sum()
            return ((p - n) / (p + n) if p + n else -1.0, int(p))

        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (worth(r), -len(r)))
        inside = _covered(rule, x, names) & left
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        score, seen = worth(rule)
        if p < least or p < precision * (p + n) or (seen and (score + 1) / 2 < precision - 0.05):
            failed += 1
            continue
        failed = 0
        rules.append(rule)
        left &= ~inside
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, *, label: str = "quality", seed: int = 42, max_labelled: int = 20_000) -> list[Rule]:
    """Rules that reject what ``label`` marks with 0."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_good"))
    # drawn among the documents that are there, so that the sample doesn't shrink with them
    usable = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = F.broadcast(usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id").groupBy("doc_id", "_good").agg(F.min("text").alias("text"))
    rows = text_statistics(sample, keep_text=False).orderBy("doc_id", *STATISTICS, "_good").toArrow()
    if not len(rows):
        return []
    good = np.array(rows["_good"].to_pylist()) != 0
    stats = {s: rows[s].to_numpy().astype(float) for s in STATISTICS}
    names = list(RATIOS)
    x = np.stack([np.divide(stats[a], stats[b], out=np.zeros(len(good)), where=stats[b] > 0) for a, b in RATIOS.values()], axis=1)
    return fit_rules(x, ~good, names)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True for texts that no rule rejects: the list as an ordered conditional."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        every = F.lit(True)
        for c in rule:
            every = every & c.column(prefix)
        out = out.when(every, F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed(prefix: str = "") -> Column:
    """Too short, or too much of it repeats."""
    return (F.col(f"{prefix}n_words") < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * F.col(f"{prefix}n_words"))
