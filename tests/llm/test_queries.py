"""The registered op queries, as they are registered, against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from lattica.llm import media, quality, toxicity
from lattica.llm.tokens import tokenizer_path
from tests.llm.test_learned import plain_statistics
from tests.llm.test_mixing import expected_targets
from tests.llm.test_simhash import plain_components, plain_fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(17)
    vocab = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))
    rows = []
    for i in range(240):
        text = prose(rng.randrange(5, 120))
        if i % 5 == 0:
            text = " ".join(w + rng.choice([" ###", " $$", " |"]) for w in text.split())
        if i % 4 == 1:
            text += " vilest vileness"
        rows.append((i * 3, text, "en", ["a", "b", "c", None][rng.choice([0, 0, 0, 0, 1, 1, 2, 3])], len(text)))
    rows += [(5000 + k, r[1].upper() if k % 2 else r[1], "en", r[3], r[4]) for k, r in enumerate(rows[:20])]
    rows += [(6000 + k, r[1] + " tail", "en", "d", r[4]) for k, r in enumerate(rows[20:30])]
    rows += [(7000, None, None, "a", 0), (7001, "", None, None, 0), (7002, " \n\t ", None, "b", 3), (7003, prose(9000), "en", "a", 0), (7004, "one", "en", "z", 3), (7005, "日本 語 " * 40, "ja", "z", 1)]
    labels = [(i * 3, int(i % 5 != 0), int(i % 4 == 1)) for i in range(240)] + [(None, 1, 1), (7000, None, None), (99_999, 0, 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def run(spark, path, number, types):
    """Rows of the query opN_<name> by doc_id; its contract's columns must have these types."""
    (name,) = [n for n in __spark_entry__.queries() if n.startswith(f"op{number}_")]
    df = __spark_entry__.queries()[name](spark, path)
    found = dict(df.dtypes)
    assert {c: found.get(c) for c in types} == types
    return df.collect()


def test_op1(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in run(spark, path, 1, {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})}
    assert len(got) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    of_source, taken = defaultdict(int), defaultdict(int)
    for i, _, _, s, _ in rows:
        of_source[s] += size[i]
        taken[s] += got[i]["taken"]
    want = expected_targets(dict(of_source))
    for i, _, _, s, _ in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], of_source[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * size[i]
    assert all(abs(taken[s] - t) <= max(1, 0.02 * t) for s, t in want.items())
    again = {r["doc_id"]: r["taken"] for r in run(spark, path, 1, {})}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_op3(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in run(spark, path, 3, {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})}
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    assert len(got) == len(rows)
    for i, text, *_ in sorted(rows):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op4(spark, tables, tmp_path):
    path, rows, labels = tables
    got = {r["doc_id"]: r for r in run(spark, path, 4, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})}
    docs, marks = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, marks, learn_from=~toxicity.held_out(F.col("doc_id")))
    known = {f: i for i, f in enumerate(model.weights)}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        z = model.bias + sum(model.weights[f] for f in toxicity.features_of(toxicity.words_of(text), known))
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["score"] == pytest.approx(1 / (1 + np.exp(-z))) and r["predicted"] == int(r["score"] >= 0.7)
    hidden = [k * 3 for k in range(240) if got[k * 3]["held_out"]]
    assert sum(got[i]["predicted"] == int(i // 3 % 4 == 1) for i in hidden) >= 0.95 * len(hidden)
    # labels of held-out rows change nothing
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    flipped = [(i, q, t if i is None or t is None or zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, q, t in labels]
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r["doc_id"]: r["score"] for r in run(spark, str(tmp_path), 4, {})} == {i: r["score"] for i, r in got.items()}


def test_op5(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in run(spark, path, 5, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}
    marks = {r[0]: plain_fingerprint(r[1]) for r in rows}
    ids = sorted(marks)
    want = plain_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (marks[a] ^ marks[b]).bit_count() <= 4])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{marks[i]:016x}", want[i]) for i in ids}
    assert len(set(want.values())) < len(ids) - 10


def test_op6(spark, tables):
    path, rows, _ = tables
    got = {r["doc_id"]: r for r in run(spark, path, 6, {"doc_id": "bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), "base_failed": "boolean", "kept": "boolean"})}
    rules = quality.learn_rules(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels")))
    assert len(got) == len(rows) and rules
    for i, text, *_ in rows:
        stats = dict(zip(quality.STATISTICS, plain_statistics(text)))
        value = {n: stats[a] / stats[b] if stats[b] else 0.0 for n, (a, b) in quality.RATIOS.items()}
        rejected = any(all((value[c.name] > c.limit) == c.above for c in rule) for rule in rules)
        base = stats["n_words"] < 10 or 100 * stats["n_repeat_words"] > 20 * stats["n_words"]
        r = got[i]
        assert [r[c] for c in quality.STATISTICS[:5]] == [stats[c] for c in quality.STATISTICS[:5]]
        assert (r["base_failed"], r["kept"]) == (base, not base and not rejected)


def test_op7(spark, tables):
    path, rows, _ = tables
    longs = ("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes")
    got = {r["doc_id"]: r for r in run(spark, path, 7, {**dict.fromkeys(longs, "bigint"), **dict.fromkeys(("payload_sha256", "media_sha256", "feature"), "string")})}
    assert len(got) == len(rows)
    seen = {}
    for i, text, *_ in rows:
        raw, r = (text or "").encode(), got[i]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and f"samples={len(payload) // 64}|" in r["feature"]
        assert seen.setdefault(raw, r["feature"]) == r["feature"]


def test_op8(spark, tables):
    path, rows, _ = tables
    longs = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    got = run(spark, path, 8, dict.fromkeys(longs, "bigint"))
    plain = Tokenizer.from_file(tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for i, text, *_ in rows:
        ids, at = [*plain.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at.bit_count() == 1  # full at a power of two: nothing is padded
