import random
import re

import numpy as np
import pytest

import __spark_entry__
from lattica.llm import minhash, simhash
from tests.llm.test_simhash import plain_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def expected(rows):
    """(n_shingles, component) of each row, by all pairs of distinct sets."""
    sets = [plain_set(t) for _, t in rows]
    kinds = list(dict.fromkeys(s for s in sets if s))
    linked = [(i, j) for i, a in enumerate(kinds) for j, b in enumerate(kinds[:i]) if 100 * len(a & b) >= 80 * len(a | b)]
    root = plain_components(range(len(kinds)), linked)
    of = {s: root[i] for i, s in enumerate(kinds)}
    first = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            first[of[s]] = min(first.get(of[s], i), i)
    return [(len(s), first.get(of[s]) if s else i) for (i, _), s in zip(rows, sets)]


def edited(base, edits, rng):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = "Edited%d" % rng.randrange(10**9)
    return " ".join(words)


def odd_rows():
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (4, 5, 8, 9, 40, 120, 400):
        base = prose(n)
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base, "more"]), " ".join([*base, *prose(max(1, n // 4))])]
        texts += [edited(base, k, rng) for k in (1, 2, n // 60 + 1) if k < n]
    crowd = prose(150)  # most of these are similar to the first, few to each other
    texts += [" ".join(crowd)] + [edited(crowd, rng.choice([2, 3, 4]), rng) for _ in range(150)]
    page = prose(120)  # one template, none similar
    texts += [" ".join([*page, *prose(30)]) for _ in range(120)]
    texts += [None, "", " \n\t", None, "one", "ONE", "one two", "one two three", "Ünï code", "ünï code", " ".join(prose(20_000)), "x " * 30_000]
    rows = [(1000 + 7 * i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, texts[0]), (None, "alone without a name"), rows[0], rows[0], (3, texts[4]), (1, None), (1, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("minhash")), odd_rows()
    spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, node string, N int, key int").repartition(5).write.parquet(f"{path}/documents.parquet")
    return path, rows


@pytest.mark.parametrize("small", [False, True])
def test_op11_against_all_pairs(spark, folder, small, monkeypatch):
    path, rows = folder
    if small:  # crowded buckets, hot parts and groups in several chunks
        monkeypatch.setattr(minhash, "CROWD", 5)
        monkeypatch.setattr(simhash, "TASK_ENTRIES", 4000)
    df = __spark_entry__.queries()["op11_circulant_minhash"](spark, path)
    types = dict(df.dtypes)
    assert (types["doc_id"], types["n_shingles"], types["component_id"], types["kept"]) == ("bigint", "bigint", "bigint", "boolean")
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())))
    want = expected(rows)
    assert got == sorted(str((i, n, c, i is not None and i == c)) for (i, _), (n, c) in zip(rows, want))


def test_signatures_are_circulant():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 5000):
        h = rng.integers(0, 2**64, n, np.uint64)
        x = minhash.scattered(h)
        assert minhash.signature(h, 60).tolist() == [int(minhash.permuted(x + np.uint64(k)).min()) for k in range(60)]
    x = rng.integers(0, 2**64, 100_000, np.uint64)
    assert len(np.unique(minhash.scattered(x))) == len(np.unique(minhash.permuted(x))) == len(np.unique(x))


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_coordinates_agree_as_often_as_sets_are_similar(similarity):
    rng = np.random.default_rng(4)
    common = round(400 * 2 * similarity / (1 + similarity))
    agree = []
    for _ in range(100):
        h = rng.integers(0, 2**64, 800 - common, np.uint64)
        agree.append((minhash.signature(h[:400], 200) == minhash.signature(np.append(h[:common], h[400:]), 200)).mean())
    true = common / (800 - common)
    assert abs(np.mean(agree) - true) < 0.015 and np.std(agree) < 1.3 * (true * (1 - true) / 200) ** 0.5


def test_empty_and_bad(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, similarity=0)
