import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from lattica.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(rows, every=31):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if every and h % every == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    by = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), ws in by.items():
        for w in ws | ({a + b} & set(words)):
            near[w] |= (ws | ({a + b} & set(words))) - {w}
    # words that lack one letter are near those that have it, not each other by that alone
    one = lambda x, y: len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1 or abs(len(x) - len(y)) == 1
    return {w: {v for v in vs if one(w, v)} for w, vs in near.items()}


def plain_variants(counts, ratio=10):
    near, form = plain_near(counts), {}
    for w, n in counts.items():
        if near.get(w):
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near.get(w, ())), counts[form[w]] if w in form else None) for w, n in counts.items()}


def sample_rows():
    rng = random.Random(13)
    letters = "abcdeéß×"
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 13))) for _ in range(150)]
    vocab += [f"commonprefix{a}{b}" for a in letters for b in letters] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaa", "abcdefg" * 20]
    weights = [1 / (1 + k) for k in range(len(vocab))]

    def typo(w):
        at, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])

    def prose(n):
        words = rng.choices(vocab, weights, k=n)
        return " ".join(typo(w) if rng.random() < 0.1 else w.upper() if rng.random() < 0.1 else w for w in words)

    rows = [(i, prose(60)) for i in range(300)] + [(900, None), (901, ""), (902, "123 -- 日本"), (903, prose(20_000)), (None, prose(50)), (4, prose(9)), (4, prose(9))]
    # counts of 1, 10, 100 and more: forms of forms
    chain = ["chainwordabc", "chainwordabd", "chainwordaed"]
    return rows + [(5000 + k, " ".join([chain[0]] * 2 + [chain[1]] * 25 + [chain[2]] * 300)) for k in range(2)] + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("spelling")), sample_rows()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, N int").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path, rows


@pytest.mark.parametrize("small", [False, True])
def test_op13_against_brute_force(spark, folder, small, monkeypatch):
    path, rows = folder
    if small:  # many bins, halves in chunks, counts passed on early
        monkeypatch.setattr(spelling, "BIN_WORDS", 300)
        monkeypatch.setattr(spelling, "HOT_WORDS", 4)
        monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    df = __spark_entry__.queries()["op13_spelling_variants"](spark, path)
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    assert [dict(df.dtypes)[c] for c in names] == ["string"] * 3 + ["bigint"] * 3
    got = [tuple(r[c] for c in names) for r in df.collect()]
    want = plain_variants(plain_counts(rows))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(f and r != f for _, f, r, *_ in want) and sum(x[4] for x in want) > 300


def test_automaton_numbers_words():
    rng = random.Random(14)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    a = spelling.Automaton(words)
    for i, w in enumerate(words):
        state, number = a.walk(w, a.start, 0)
        assert a.final[state] and number == i
    assert a.walk("zz", a.start, 0) is None
    # minimal: no two states have the same words behind them
    tails = {}
    for s in range(len(a.arcs)):
        tails[s] = frozenset({""} if a.final[s] else set()) | {c + t for c, (to, _) in a.arcs[s].items() for t in tails[to]}
    assert len(set(tails.values())) == len(tails)
    for w in words[:60]:
        one = {v for v in words if (len(v) == len(w) and sum(p != q for p, q in zip(v, w)) == 1 or len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v))))}
        for half in range(len(w) + 1):
            assert {words[i] for i in a.one_error(w, half)} == {v for v in one if v.startswith(w[:half])}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(docs)).count() == 0
    assert spelling.count_words(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0
