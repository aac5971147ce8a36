import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import common, token_store
from lattica.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, ids string"


def build(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    store = token_store.write_tokens(docs, common.shared_dir(spark) + "/t", tokenizer_path(), end_id=2)
    return docs, store


def test_layout_and_read_back(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TEXT", 2000)
    monkeypatch.setattr(token_store, "BUCKET_KEYS", 20)
    monkeypatch.setattr(token_store, "PIECE", 64)
    monkeypatch.setattr(token_store, "HELD_IDS", 500)
    rng = random.Random(4)
    rows = [(i * 7 - 300, "Héllo wörld, " * rng.randrange(12), "clash") for i in range(150)]
    rows += [(None, "null key", ""), (None, "null key", ""), (3, None, ""), (3, "", ""), (3, "again", ""), (-(2**63), "least", ""), (2**63 - 1, "most", ""), (10**9, "long text " * 3000, "")] + [(12, f"copy {i}", "") for i in range(300)]
    docs, store = build(spark, rows)
    assert len(store.rows) > 3 and store.buckets > 3 and store.width == 2
    got = token_store.crc_of_ids(token_store.read_tokens(token_store.lookup(docs, store), store)).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = []
    for k, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k is not None, k or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):  # gapless, in key order
        assert r["start"] == start
        start += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys)
    assert [len(x) for x in token_store.read_document(store, 3)] and len(token_store.read_document(store, 3)) == 3
    assert len(token_store.read_document(store, 12)) == 300 and len(token_store.read_document(store, None)) == 2
    assert token_store.read_document(store, 424242) == []
    asked = spark.createDataFrame([(12,), (999_999,), (12,)], "doc_id long")
    assert token_store.lookup(asked, store).agg(F.sum("copies")).first()[0] == 300


def test_empty(spark):
    docs, store = build(spark, [])
    assert store.rows == [] and token_store.read_tokens(token_store.lookup(docs, store), store).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        table = token_store.PerfectHash.build(keys)
        assert sorted(table.slots(keys)) == list(range(len(keys)))
        again, _ = token_store.PerfectHash.from_bytes(table.to_bytes())
        assert (again.slots(keys) == table.slots(keys)).all()
        others = rng.integers(0, 2**64, 1000, np.uint64)
        assert again.slots(others).max(initial=-1) < max(len(keys), 1)


def test_lookup_reads_as_much_from_large_buckets(spark, monkeypatch):
    """Bytes read for one key don't grow with its bucket and shard."""
    most = {}
    for n in (200, 20_000):
        monkeypatch.setattr(token_store, "BUCKET_KEYS", n)
        docs, store = build(spark, [(i, "some words", "") for i in range(n)])
        assert store.buckets == 1
        for key in range(0, n, n // 50):
            seen: list[int] = []
            assert [len(x) for x in token_store.read_document(store, key, seen)] == [3]
            levels = sum(s == token_store.LINE for s in seen)
            assert sum(seen) - levels * token_store.LINE < 400
            most[n] = max(most.get(n, 0), levels)
        assert most[n] < 12
