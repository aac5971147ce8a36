from collections import defaultdict

import pytest

from lattica.llm import sharding


def check(spark, data, limit):
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string, n_bytes long")
    found = sharding.shard_rows(docs, limit)
    rows = found.rows.collect()
    assert sorted((str(r["key"]), r["n_bytes"]) for r in rows) == sorted((str(d[0]), len((d[1] or "").encode())) for d in data)
    size, n = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r["shard"]] += r["n_bytes"]
        n[r["shard"]] += 1
    for r in rows:
        assert size[r["shard"]] == r["shard_bytes"]
        assert r["shard_bytes"] <= limit or n[r["shard"]] == 1
    names = {s.partition(".")[0] for s in size}
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # leaves of one directory
    for s in names:  # only what was too large has split
        if s:
            parent = s[:-1]
            assert sum(v for k, v in size.items() if k.startswith(parent)) > limit
    return size


def test_splits_only_what_is_too_large(spark):
    data = [(i, "x" * (i % 50), "clash", 1) for i in range(500)] + [(None, None, "", 0), (7, "é" * 20, "", 0)]
    assert len(check(spark, data, 700)) > 10
    assert set(check(spark, data[:3], 10_000)) == {""}


def test_hot_key_copies_and_giants(spark):
    data = [(5, f"text {i}" * 5, "", 0) for i in range(60)] + [(6, "same text", "", 0)] * 40 + [(8, "y" * 5000, "", 0), (None, "n", "", 0), (None, "n", "", 0)]
    size = check(spark, data, 100)
    assert max(size.values()) == 5000


def test_empty_and_write(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_rows(docs, 10).rows.count() == 0
    docs = spark.createDataFrame([(i, "abc" * i) for i in range(30)], "doc_id long, text string")
    found = sharding.shard_rows(docs, 200)
    sharding.write_shards(docs, found, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 30


@pytest.mark.parametrize("leaves", [200_000, 3])
def test_writes_each_row_once(spark, tmp_path, monkeypatch, leaves):
    """A hot key over many shards, and repeated rows on overflow pages."""
    monkeypatch.setattr(sharding, "SMALL_DIRECTORY", leaves)
    data = [(5, f"text {i}" * 5, "a") for i in range(60)] + [(6, "same text", str(i)) for i in range(40)] + [(8, "y" * 5000, "b"), (None, "n", "c"), (None, "n", "d"), (None, None, "e"), (6, "", "f"), (6, None, "g")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = sharding.shard_rows(docs, 100)
    sharding.write_shards(docs, found, str(tmp_path / "s"))
    read = sharding.read_shards(docs, str(tmp_path / "s"))
    rows = read.collect()
    assert sorted(map(str, data)) == sorted(str((r["doc_id"], r["text"], r["lang"])) for r in rows)
    size, n = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r["shard"]] += len((r["text"] or "").encode())
        n[r["shard"]] += 1
    assert len(size) > 20 and all(b <= 100 or n[s] == 1 for s, b in size.items())
    columns = ["key", "n_bytes", "shard", "depth", "page", "shard_bytes"]
    assert sorted(map(str, found.rows.select(*columns).collect())) == sorted(map(str, sharding.written_sizes(read).select(*columns).collect()))
