"""Toxicity by non-negative positive-unlabelled learning (nnPU).

A linear numpy classifier learns from confirmed toxic documents (P) and from unlabelled text
(U), documents drawn from all there are, whether they have a label or not and without a look
at it, with the class-prior-corrected risk

    pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),

where R(+) and R(-) are mean logistic losses as if labelled 1 or 0. Where the second term
falls below zero, a step is taken against it, which keeps the model from fitting U's hidden
positives as negatives. pi is the share of toxic rows among the labelled ones to learn from.

Features are presences in the whole text of words, of word prefixes of 3 to 8 characters,
and of prefixes that at least two different words of the text share. Candidates occur in
``MIN_SHARE`` of P; those stay that are significantly more frequent in P than in U. Nothing
but the text is looked at when scoring.

The classifier is fitted on samples of at most ``max_positive`` labelled rows and
``max_unlabelled`` documents, drawn by a hash of doc_id; of their features the ``max_candidates``
most frequent ones in P are looked at, and the ``max_features`` most telling of these are used.
Every text is scored as a whole.

Defined cases: null and empty texts, and texts without known features, score as the bias
says; without a confirmed toxic row every score is 0; labels without a text and null labels
teach nothing; rows of one doc_id are one document to learn from; other columns are kept, but
for one named like the score's (``score`` unless told otherwise).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, scratch

MIN_SHARE, MIN_LIFT, MIN_G2 = 0.004, 2.0, 12.0
PREFIXES = range(3, 9)
#: Marks aside: they separate words, as blanks do.
BLANKS = str.maketrans(dict.fromkeys("\t\n\v\f\r.,;:!?\"'()[]{}<>#$%&*|+=/\\@^~`_", " "))


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().translate(BLANKS).split(" "))


def features_of(words: set[str], known: dict[str, int] | None = None) -> set[str]:
    """All features of a text's distinct words; of the shared prefixes only those in ``known``, if given."""
    found = {f"w{w}" for w in words if w}
    shared = Counter(w[:k] for w in words for k in PREFIXES if len(w) >= k)
    found |= {f"p{x}" for x in shared}
    found |= {f"s{x}" for x, n in shared.items() if n > 1}
    return found if known is None else {f for f in found if f in known}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def parts(self) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
        return tuple({f[1:]: w for f, w in self.weights.items() if f[0] == kind} for kind in "wps")


class Scorer:
    """Scores texts; a word's prefixes that matter are looked up once and kept."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.word, self.prefix, self.shared = model.parts()
        self.bias, self.keep, self.seen = model.bias, keep, {}

    def _hits(self, w: str) -> tuple[float, tuple[str, ...]]:
        if len(self.seen) > self.keep:
            self.seen.clear()
        found = tuple(w[:k] for k in PREFIXES if len(w) >= k and (w[:k] in self.prefix or w[:k] in self.shared))
        hits = self.seen[w] = (self.word.get(w, 0.0), found) if found or w in self.word else None
        return hits

    def score(self, text: str | None) -> float:
        seen, total, prefixes = self.seen, 0.0, []
        for w in words_of(text):
            hits = seen[w] if w in seen else self._hits(w)
            if hits:
                total += hits[0]
                prefixes += hits[1]
        for x, n in Counter(prefixes).items():
            total += self.prefix.get(x, 0.0) + (self.shared.get(x, 0.0) if n > 1 else 0.0)
        z = self.bias + total
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def fit_nnpu(rows: Sequence[np.ndarray], positive: np.ndarray, n_features: int, prior: float, *, steps: int = 3000, rate: float = 0.05, decay: float = 1e-5, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: feature numbers of each document; positive: which are P, the others being U."""
    sizes = np.array([len(r) for r in rows], np.int64)
    at = np.repeat(np.arange(len(rows)), sizes)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    theta, m, v = (np.zeros(n_features + 1) for _ in range(3))
    theta[-1] = math.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    for step in range(1, steps + 1):
        z = np.bincount(at, theta[flat], minlength=len(rows)) + theta[-1]
        sig = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss_neg = np.logaddexp(0, z)
        rest = loss_neg[u].sum() / n_u - prior * loss_neg[p].sum() / n_p
        g = np.zeros(len(rows))
        if rest >= -beta:
            g[p] = prior * (sig[p] - 1) / n_p - prior * sig[p] / n_p
            g[u] = sig[u] / n_u
        else:  # against the negative part
            g[p] = prior * sig[p] / n_p
            g[u] = -sig[u] / n_u
        grad = np.append(np.bincount(flat, g[at], minlength=n_features), g.sum()) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, *, learn_from: Column | None = None, seed: int = 42, label: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 6000, max_candidates: int = 40_000, max_features: int = 4096) -> Model:
    """Fit on labelled rows, and on documents as unlabelled text, for which ``learn_from`` (by doc_id) holds.

    pi is the share of toxic ones among these labelled rows that have a document. Rows of one
    doc_id count as one document, that of the least text.
    """
    allowed = F.lit(True) if learn_from is None else learn_from
    present = docs.where(F.col("doc_id").isNotNull() & allowed).select("doc_id").distinct()
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).select("doc_id", F.col(label).cast("int").alias("_y"))
    # labels of documents that aren't there would make pi differ from U's share of positives
    usable = usable.join(present, "doc_id", "left_semi")
    n, n_toxic = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n_toxic:
        return Model({}, -1e9, 0.0)
    with scratch(docs.sparkSession):
        return _fit(docs, usable.where("_y = 1").select("doc_id").distinct(), present, n_toxic / n, seed, max_positive, max_unlabelled, max_candidates, max_features)


def _fit(docs: DataFrame, toxic: DataFrame, present: DataFrame, prior: float, seed: int, max_positive: int, max_unlabelled: int, max_candidates: int, max_features: int) -> Model:
    draw = lambda ids, salt, n: ids.orderBy(F.xxhash64(F.lit(seed + salt), "doc_id"), "doc_id").limit(n)
    drawn = draw(toxic, 0, max_positive).select("doc_id", F.lit(True).alias("_p")).unionByName(draw(present, 1, max_unlabelled).select("doc_id", F.lit(False).alias("_p")))
    drawn = F.broadcast(drawn)  # at most max_positive + max_unlabelled ids
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id").groupBy("doc_id", "_p").agg(F.min("text").alias("text"))
    sample = materialise(sample.select("text", "_p").repartition(12), "sample")

    def count(known: dict[str, int] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got: Counter[str] = Counter()
                for t in b["text"]:
                    got.update(features_of(words_of(t), known))
                yield pd.DataFrame({"f": list(got), "n": list(got.values())})

        return run

    n_p, n_u = sample.agg(F.count_if("_p"), F.count_if(~F.col("_p"))).first()
    least = max(3, math.ceil(MIN_SHARE * n_p))
    sums = lambda frame, known=None: frame.select("text").mapInPandas(count(known), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    in_p = {r["f"]: r["n"] for r in sums(sample.where("_p")).where(F.col("n") >= least).orderBy(F.desc("n"), "f").limit(max_candidates).collect()}
    in_u = {r["f"]: r["n"] for r in sums(sample.where("not _p"), dict.fromkeys(in_p, 0)).collect()}
    names = _select(list(in_p), np.array(list(in_p.values()), float), np.array([in_u.get(f, 0) for f in in_p], float), max(1, n_p), max(1, n_u), max_features)
    known = {f: i for i, f in enumerate(names)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": b["_p"], "f": [sorted(known[f] for f in features_of(words_of(t), known)) for t in b["text"]]})

    got = sample.mapInPandas(hits, "p boolean, f array<int>").toPandas()
    got = got.assign(key=[(not p, *f) for p, f in zip(got["p"], got["f"])]).sort_values("key")  # sums must not depend on the order of rows
    weights, bias = fit_nnpu([np.array(f, np.int64) for f in got["f"]], got["p"].to_numpy(bool), len(names), prior)
    return Model({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-6}, bias, prior)


def _select(names: list[str], a: np.ndarray, b: np.ndarray, n_p: int, n_u: int, most: int) -> list[str]:
    """Names that are more frequent in P (a of n_p) than in U (b of n_u), by the likelihood ratio."""
    expect = (a + b) / (n_p + n_u)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.nan_to_num(a * np.log(a / (expect * n_p))) + np.nan_to_num(b * np.log(b / (expect * n_u))))
    good = np.flatnonzero((a / n_p >= MIN_LIFT * (b + 0.5) / n_u) & (g2 >= MIN_G2))
    return [names[i] for i in good[np.argsort(-g2[good], kind="stable")][:most]]


def score_texts(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Add a column with the probability that a text is toxic; it replaces one of that name in any case."""
    kept = [f for f in docs.schema if f.name.lower() != into.lower()]

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model)
        for b in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), scores], [*(f.name for f in kept), into])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
