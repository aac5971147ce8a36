import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__
from lattica.llm import resampling
from lattica.operators import scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [x.encode() for x in w] + [f"{x} {y}".encode() for x, y in zip(w, w[1:])]


def expected(rows, target):
    sums = [np.bincount([zlib.crc32(f) % 10_000 for t in ts for f in features(t)[1]], minlength=10_000).tolist() for ts in ([t for _, t in rows], target)]
    s_all, t_all = sum(sums[0]), sum(sums[1])
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(*sums)]
    out = []
    for i, t in rows:
        n, fs = features(t)
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long[: 25 * len(long) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def sample_rows():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcXYZ019éß日") for _ in range(rng.randrange(1, 8))) for _ in range(600)]
    prose = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "-", "'", "\n", ", "]) for _ in range(n))
    rows = [(3 * i, prose(rng.randrange(5, 90))) for i in range(500)]
    rows += [(9001, None), (9002, ""), (9003, " .,\x00\x7f"), (9004, prose(80_000)), (9005, "one"), (9006, "A" * 5000), (9007, prose(20)), rows[7], rows[7], (None, prose(40)), (None, prose(19))]
    return rows, [prose(30) for _ in range(20)] + [None, "", "One one ONE"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (rows, target) = str(tmp_path_factory.mktemp("resampling")), sample_rows()
    spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "doc_id long, text string, n_words int, Rank int, weight double").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, target


def text_of(row):
    return str(tuple(row))


@pytest.mark.parametrize("small", [False, True])
def test_op12_against_brute_force(spark, folder, small, monkeypatch):
    path, rows, target = folder
    if small:  # many blocks, slices and ranges
        monkeypatch.setattr(resampling, "BLOCK_ENTRIES", 100)
        monkeypatch.setattr(resampling, "SLICE", 1000)
        monkeypatch.setattr(scan.running_sums, "__kwdefaults__", {"part_rows": 50})
        monkeypatch.setattr(scan.ranked, "__kwdefaults__", {"part_rows": 50})
    df = __spark_entry__.queries()["op12_importance_resampling"](spark, path)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    assert {c: dict(df.dtypes)[c] for c in names} == dict.fromkeys(names, "bigint")
    got, want = [tuple(r[c] for c in names) for r in df.collect()], expected(rows, target)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 25 * sum(features(t)[0] >= 20 for _, t in rows) // 100 + 1))
    same = lambda found: sorted(text_of(r[:4]) for r in found)
    assert same(got) == same(want)
    once = lambda found: {r[0]: r for r in found if r[0] not in (None, rows[7][0])}  # noqa: E731  rows alike may change ranks among each other
    assert once(got) == once(want)


def test_blocks_hold_the_matrix(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    matrix = resampling.write_counts(docs)
    seen = []
    for batch in matrix.toArrow().to_batches():
        for keys, n_words, ends, at, n in resampling.blocks_of(batch, "<u2"):
            assert len(keys) == len(n_words) == len(ends) - 1 and ends[-1] == len(at) == len(n)
            seen += [(k, w, dict(zip(at[a:b].tolist(), n[a:b].tolist()))) for k, w, a, b in zip(keys.to_pylist(), n_words.tolist(), ends, ends[1:])]
    want = []
    for i, t in rows:
        n, fs = features(t)
        counts = {}
        for f in fs:
            counts[zlib.crc32(f) % 10_000] = counts.get(zlib.crc32(f) % 10_000, 0) + 1
        want.append((i, n, counts))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(seen, key=order) == sorted(want, key=order)
    sums = resampling.column_sums(matrix)
    assert sums.sum() == sum(len(features(t)[1]) for _, t in rows)


def test_empty_tables_and_shares(spark, folder):
    path, *_ = folder
    docs, target = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    assert resampling.resample(docs.limit(0), target).count() == 0
    none = resampling.resample(docs, target.limit(0), share=0.0)
    assert none.count() == docs.count() and none.where("rank is not null").isEmpty()
    assert resampling.resample(docs, target, share=1.0, least_words=0).where("rank is null").isEmpty()
    with pytest.raises(ValueError):
        resampling.resample(docs, target, share=1.5)
