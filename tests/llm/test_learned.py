import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n_of = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n_of[w] > 1 for j in range(i, i + 5)}
    ascii_ = [c for c in text if c.isascii() and c.isalpha()]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), sum(c.isupper() for c in ascii_), len(ascii_), text.count("!"), text.count("|"), sum(a == b for a, b in zip(words, words[1:])), len(set(words))]


def test_statistics(monkeypatch):
    rng = random.Random(3)
    texts = ["", " \n ", "a\na\n\n\nb\na ", "x y z v w x y z v w", "É ü#! " * 9, "a b c d e f"] + [" ".join(rng.choice(["a", "b", "É!", "#", "\n", "x|"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    got = quality.statistics([t.encode() for t in texts])
    assert got.tolist() == [plain_statistics(t) for t in texts]
    monkeypatch.setattr(quality, "LARGE", 3)
    assert quality.statistics([t.encode() for t in texts]).tolist() == got.tolist()


def test_colliding_windows_are_told_apart():
    ids = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 1, 2, 3, 4], np.int64)
    assert quality._repeats(ids, np.zeros(15, np.int64), 1).tolist() == [10]
    assert quality._repeats(ids, np.array([0] * 6 + [1] * 9), 2).tolist() == [0, 0]


def test_decision_list(spark):
    rng = np.random.default_rng(1)
    names = list(quality.RATIOS)
    x = rng.random((3000, len(names)))
    bad = (x[:, 1] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 4] <= 0.3))
    rules = quality.fit_rules(x, bad, names)
    said = np.zeros(len(x), bool)
    for r in rules:
        said |= quality._covered(r, x, names)
    assert (said == bad).mean() > 0.97 and quality.fit_rules(x[:0], bad[:0], names) == [] and quality.fit_rules(x, np.zeros(3000, bool), names) == []
    frame = spark.createDataFrame([(0,) * len(quality.STATISTICS), (10, 50, 9, 0, 0, 1, 9, 0, 9, 0, 10)], ",".join(f"{s} long" for s in quality.STATISTICS))
    emitted = frame.select(quality.verdict(rules).alias("k"), quality.base_failed().alias("b")).collect()
    assert all(r["k"] is not None for r in emitted) and emitted[0]["b"]
    assert frame.select(quality.verdict([]).alias("k")).first()["k"] is True


def test_learns_quality_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_rules(docs, labels.where("doc_id % 2 = 0"))
    stats = quality.text_statistics(docs).withColumn("kept", ~quality.base_failed() & quality.verdict(rules))
    got = stats.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept", "n_words").collect()
    bad = [r for r in got if r["quality"] == 0]
    good = [r for r in got if r["quality"] == 1 and r["n_words"] >= 10]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad) and sum(r["kept"] for r in good) >= 0.97 * len(good)


def test_statistics_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "clash", 5), (None, "a b", "", 6), (1, None, "clash", 5)], "doc_id long, text string, n_words string, other int")
    got = quality.text_statistics(docs)
    assert "other" in got.columns and dict(got.dtypes)["n_words"] == "bigint" and got.count() == 3
    assert quality.text_statistics(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 0), (77, 0)], "doc_id long, quality int")
    assert quality.learn_rules(docs, labels) == [] and quality.learn_rules(docs.limit(0), labels) == []


def test_nnpu_separates():
    rng = np.random.default_rng(2)
    rows, positive = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        rows.append(np.array(sorted({0, 1} & set(rng.integers(0, 2, 2).tolist())) if toxic else [], np.int64) if toxic else np.array([2 + rng.integers(0, 8)]))
        positive.append(toxic and i % 2 == 0)
    w, b = toxicity.fit_nnpu(rows, np.array(positive), 10, 0.2)
    assert np.isfinite(w).all() and min(w[0], w[1]) + b > 0 and max(w[2:]) + b < 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, learn_from=~toxicity.held_out(F.col("doc_id")))
    test = labels.where(toxicity.held_out(F.col("doc_id"))).join(docs, "doc_id")
    got = toxicity.score_texts(test.select("doc_id", "text", "toxic"), model).select("toxic", "score").collect()
    hit = sum(r["toxic"] == 1 and r["score"] >= 0.7 for r in got)
    false = sum(r["toxic"] == 0 and r["score"] >= 0.7 for r in got)
    assert hit >= 0.9 * sum(r["toxic"] == 1 for r in got) and false <= 0.01 * len(got)


def test_scores_of_odd_tables(spark):
    model = toxicity.Model({"wbad": 3.0, "pbad": 1.0, "sbad": 2.0}, -2.0, 0.1)
    texts = [None, "", "fine", "BAD!", "bad badly", "x" * 100_000, "badly"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
    z = {0: -2, 1: -2, 2: -2, 3: 2, 4: 4, 5: -2, 6: -1}
    assert {k: pytest.approx(1 / (1 + math.exp(-v))) for k, v in z.items()} == got
    none = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int"))
    assert all(r["score"] == 0 for r in toxicity.score_texts(docs, none).collect()) and toxicity.score_texts(docs.limit(0), none).count() == 0
    for t in texts[1:]:  # the scorer's shortcut agrees with the features
        known = {f: i for i, f in enumerate(model.weights)}
        slow = model.bias + sum(model.weights[f] for f in toxicity.features_of(toxicity.words_of(t), known))
        assert toxicity.Scorer(model).score(t) == pytest.approx(1 / (1 + math.exp(-slow)))


def test_unlabelled_text_has_no_labels(spark):
    """Documents without labels are learnt from as unlabelled text, and labels elsewhere draw nothing away."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(30)] + (["vile"] if i < 60 or 1000 <= i < 1040 else []))) for i in [*range(300), *range(1000, 1400)]]
    docs = spark.createDataFrame(rows + rows[:3] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(300)] + [(i, 1) for i in range(5000, 9000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_positive=500, max_unlabelled=5000)
    assert model.prior == pytest.approx(0.2)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model, into="s").withColumnRenamed("s", "score").collect()}
    assert all((got[i] >= 0.5) == ("vile" in t) for i, t in rows)


def test_draw_is_among_present_documents(spark):
    """Labels of documents that are gone take no place in the bounded sample."""
    good, bad = "plain words stand here in a row and then some more of them ", "## $$ ## $$ ## $$ ## $$ ## $$ ## $$ "
    docs = spark.createDataFrame([(i, (bad if i % 3 == 0 else good) + str(i)) for i in range(150)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(i, 1) for i in range(1000, 4000)], "doc_id long, quality int")
    rules = quality.learn_rules(docs, labels, max_labelled=150)
    kept = quality.text_statistics(docs, prefix="q_").where(quality.verdict(rules, "q_")).select("doc_id").distinct().collect()
    assert {r[0] for r in kept} == {i for i in range(150) if i % 3}
