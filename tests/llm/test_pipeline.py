import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lattica.llm import queries
from lattica.llm.tokens import tokenizer_path
from tests.llm.test_learned import plain_statistics
from tests.llm.test_simhash import plain_components, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "n_words", "size", "_rank", "fp", "shard"]


def vocabulary(rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = vocabulary(rng)
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for i in range(700):
        kind = rng.random()
        text, quality, toxic = prose(rng.randrange(30, 200)), 1, 0
        if kind < 0.15:
            text, quality = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split()), 0
        elif kind < 0.35:
            words = text.split()
            for at in rng.sample(range(len(words)), 6):
                words[at] = rng.choice(["zzidiot", "zzmoron", "zzscum"])
            text, toxic = " ".join(words), 1
        rows.append((i, text, "en", f"s{rng.randrange(4)}", len(text)))
        labels.append((i, quality, toxic))
    clean = [r for r, l in zip(rows, labels) if l[1:] == (1, 0)]
    for k, r in enumerate(clean[:20]):  # copies and near copies
        rows.append((1000 + k, r[1], "en", r[3], r[4]))
        rows.append((2000 + k, r[1] + " one", "en", r[3], r[4] + 4))
    rows += [(3000, None, "en", "s1", 0), (3001, "", None, None, 0), (3002, prose(6000), "en", None, 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    clashing = [(*r, *(f"{c} of {r[0]}" for c in CLASH)) for r in rows]
    spark.createDataFrame(clashing, COLUMNS + "".join(f", {c} string" for c in CLASH)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}, {l[0]: l[1:] for l in labels}


@pytest.fixture(scope="module")
def stages(spark, corpus):
    path, *_ = corpus
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        out.append((name, docs))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in stages] == ["quality_rules", "toxicity", "simhash_near_dedup", "mix_sources", "packing"]
    for _, df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASH]
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in df.collect() for c in CLASH)


def test_filters(stages, corpus):
    _, rows, labels = corpus
    first = {r["doc_id"] for r in stages[0][1].collect()}
    for i, row in rows.items():
        n, *_, = stats = plain_statistics(row[1])
        base = n < 10 or 100 * stats[4] > 20 * n
        junk = base or labels.get(i, (1, 0))[0] == 0
        assert (i in first) == (not junk)
    second = {r["doc_id"] for r in stages[1][1].collect()}
    assert second == {i for i in first if "zz" not in rows[i][1]}


def test_one_of_each_group(stages, corpus):
    _, rows, _ = corpus
    before, after = ({r["doc_id"] for r in df.collect()} for _, df in stages[1:3])
    sets = {i: shingles(rows[i][1]) for i in before}
    ids = sorted(before)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert after == set(plain_components(ids, linked).values()) and len(after) < len(before)


def test_mix(stages):
    before, after = (df.collect() for _, df in stages[2:4])
    source = {r["doc_id"]: r["source"] for r in before}
    size, taken, words = Counter(), Counter(), defaultdict(Counter)
    for r in before:
        n = len(WORD.findall(r["text"]))
        size[r["source"]] += n
    whole = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        found = WORD.findall(r["text"])
        assert r["text"] in whole[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["source"] == source[r["doc_id"]]
        taken[r["source"]] += len(found)
        words[r["doc_id"]].update(found)
    order = sorted(s for s in size if s is not None) + [None]
    share = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        want = fixed | {s: (total - sum(fixed.values())) * share[s] / sum(share[f] for f in free) for s in free}
        if not (over := {s: 3.0 * size[s] for s in free if want[s] > 3 * size[s]}):
            break
        fixed |= over
    for s in order:
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * want[s])
    for i, n_of in words.items():
        have = Counter(WORD.findall(whole[i]))
        assert all(n <= 3 * have[w] for w, n in n_of.items())
    # whole documents, though the sources are so small that blocks are shorter than a document
    assert sum(r["text"] == whole[r["doc_id"]] for r in after) > 0.4 * len(after)


def test_packing(stages):
    before, after = stages[3][1].collect(), stages[4][1].collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in before:
        want[r["doc_id"]] += len(plain.encode(r["text"], add_special_tokens=False).ids) + 1
    got, seq = Counter(), Counter()
    for r in after:
        got[r["doc_id"]] += r["length"]
        seq[r["sequence_id"]] += r["length"]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert got == want and max(seq.values()) <= 2048
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in after])
    assert (ids == 1).sum() >= len(before)


def test_null_and_repeated_rows(spark, tmp_path):
    """Null ids, sources and texts, repeated rows and one long text go through all stages; each group keeps a row."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    rows = [(i, t, "en", None if i % 3 else "s", 1) for i, t in enumerate(texts)] * 2 + [(None, texts[0], None, "s", 1), (None, prose(50), None, None, None), (None, None, None, None, None), (7, prose(5000), "en", "s", 1), (7, prose(70), "en", "s", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, None), (3, None, 1), (5, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    deduped = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()
    assert len(deduped) == 34 and sum(r["doc_id"] is None for r in deduped) == 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, run in queries.QUERIES.items():
        assert run(spark, str(tmp_path)).count() == 0, name


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        cell = lambda r: tuple(None if v is None or v != v else str(v) for v in r)
        columns = sorted(c for c, *_ in con.execute(f"DESCRIBE {sql}").fetchall())
        want = sorted(map(str, (cell(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())))
        got = sorted(map(str, (cell(r) for r in queries.QUERIES[name](spark, sf).select(*[F.col(c) for c in columns]).collect())))
        assert got == want, name
