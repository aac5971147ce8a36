import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lattica.llm import packing
from lattica.llm.tokens import tokenizer_path


def test_pieces_restore_documents(spark):
    rng = random.Random(5)
    rows = [(i, "some words here, " * rng.randrange(40), 3) for i in range(300)] + [(900, "long " * 9000, 0), (901, None, 0), (902, "", 0), (None, "x", 0), (7, "copy", 0), (7, "copy", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").coalesce(2)
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    wide = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        wide[r["sequence_id"]].append(r)
    padded = 0
    for seq in wide.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= seq[0]["tier"] <= 2048
        padded += at != seq[0]["tier"]
    assert padded <= 2  # one for each task
    whole = defaultdict(bytes)
    single = [r for r in got if r["doc_id"] not in (7,)]
    for r in sorted(single, key=lambda r: (r["doc_id"] or -1, r["start"])):
        assert len(whole[r["doc_id"]]) == 4 * r["start"]
        whole[r["doc_id"]] += r["ids"]
    for k, t, _ in rows:
        if k != 7:
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
            assert np.frombuffer(whole[k], "<u4").tolist() == ids
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t, _ in rows if k == 7)
    steps = defaultdict(int)
    for s, seq in wide.items():
        steps[seq[0]["step_group"]] += seq[0]["tier"]
    assert max(steps.values()) <= packing.STEP_TOKENS
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_windows_are_full():
    rng = random.Random(6)
    packer, seqs = packing.Packer(pool=5000), []
    total = 0
    for i in range(2000):
        ids = np.arange(rng.choice([1, 5, 100, 128, 129, 700, 2047, 2048, 2049, 5000]), dtype=np.uint32)
        total += len(ids)
        seqs += packer.add((i, len(ids)), ids)
    seqs += packer.pack(last=True)
    sizes = [sum(p[0] for p in s) for s in seqs]
    assert sum(sizes) == total and all(n in packing.TIERS for n in sizes[:-1])
    seen = defaultdict(list)
    for s in seqs:
        for n, _, doc, start, ids in s:
            assert len(ids) == n and ids[0] == start
            seen[doc].append((start, n))
    for (_, n), parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) == n


def test_batches_are_not_held_as_objects(monkeypatch):
    """A task's memory besides the batch is bounded, however large Arrow's batches are."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [f"some words of text {i} " * 100 for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    size = batch.column("text").nbytes
    del texts
    packing.encoder(tokenizer_path())
    tracemalloc.start()
    rows = sum(b.num_rows for b in packing._pack(iter([batch]), tokenizer_path(), 1, packing.TIERS, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= batch.num_rows and peak < size
