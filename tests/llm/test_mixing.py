import re

import pytest

from lattica.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size int, target string"


def rows():
    out = [(i, " ".join(["w"] * (i % 37 + 1)), f"s{i % 4}", 7, "clash") for i in range(400)]
    out += [(1000, None, "s1", 0, ""), (1001, "", None, 0, ""), (1002, "a b\tc", None, 0, ""), (1003, "x " * 5000, "s2", 0, ""), (None, "a b c", "s0", 0, "")]
    return out + [(5, "w w w", "s1", 7, "")] * 3


def expected_targets(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        t = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_cap_and_reruns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.taken_words(mixing.mix_sources(docs, block_words=8)).collect()
    again = mixing.taken_words(mixing.mix_sources(docs.repartition(3), block_words=8)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows())
    sizes: dict = {}
    for _, t, s, *_ in rows():
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = expected_targets(sizes)
    by_target: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for s, n in sizes.items():
        taken = next(v for (size, target), v in by_target.items() if size == n and target == pytest.approx(want[s]))
        assert abs(sum(taken) - want[s]) <= 16 or abs(sum(taken) / want[s] - 1) < 0.05
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(42), F.lit("x"))).collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or got != sorted(got)


def test_draw_and_slices(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    mix = mixing.mix_sources(docs, block_words=8, shard_slots=16)
    counts = mix.counts.collect()
    per_shard, per_source = {}, {}
    for r in counts:
        per_shard[r["shard"]] = per_shard.get(r["shard"], 0) + r["blocks"]
        per_source[r["sid"]] = per_source.get(r["sid"], 0) + r["blocks"]
    assert sorted(per_shard) == list(range(len(per_shard))) and set(list(per_shard.values())[:-1]) <= {16, *per_shard.values()}
    assert per_source == {s["sid"]: s["quota"] for s in mix.sources if s["quota"]}
    # the slots are those of the counts, each place of a shard taken once, each block as often as passes say
    slots = mix.slots.collect()
    assert sorted((r["shard"], r["sid"]) for r in slots) == sorted((r["shard"], r["sid"]) for r in counts for _ in range(r["blocks"]))
    assert sorted((r["shard"], r["slot"]) for r in slots) == sorted((h, k) for h, n in per_shard.items() for k in range(n))
    assert len({(r["sid"], r["turn"], r["block"]) for r in slots}) == len(slots)
    assert len({tuple(sorted((r["sid"], r["blocks"]) for r in counts if r["shard"] == h)) for h in per_shard}) > 1
    taken = {}
    for r in mix.slices.collect():
        taken[r["sid"], r["start"]] = taken.get((r["sid"], r["start"]), 0) + r["n_words"]
    mixed = mixing.mixed_documents(docs, mix)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert words == sum(taken.values())
    long = [r["text"] for r in mixed.where("doc_id = 1003").collect()]
    assert all(set(t.split()) == {"x"} for t in long)


def test_empty(spark):
    assert mixing.taken_words(mixing.mix_sources(spark.createDataFrame([], SCHEMA))).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 0, ""), (2, " ", None, 0, "")], SCHEMA)
    assert [r["taken"] for r in mixing.taken_words(mixing.mix_sources(blank)).collect()] == [0, 0]


def test_small_sources_come_near_their_targets(spark):
    """At the default block size, sources of 1 to 3,000 words."""
    sizes = {"a": 1, "b": 20, "c": 100, "d": 300, "e": 100, "f": 3000, None: 7}
    rows = [(k * 1000 + i, "w " * min(17, n - 17 * i), s, 0, "") for k, (s, n) in enumerate(sizes.items()) for i in range(-(-n // 17))]
    for chosen in (["a", "b"], ["c", "e"], list(sizes)):
        docs = spark.createDataFrame([r for r in rows if r[2] in chosen], SCHEMA)
        want = expected_targets({s: n for s, n in sizes.items() if s in chosen})
        mix = mixing.mix_sources(docs)
        assert {p["source"]: p["target"] for p in mix.sources} == pytest.approx(want)
        size = {r[0]: len(r[1].split()) for r in rows}
        taken: dict = {}
        for r in mixing.taken_words(mix).collect():
            assert 0 <= r["taken"] <= 3 * r["size"] == 3 * size[r["doc_id"]]
            s = list(sizes)[r["doc_id"] // 1000]
            taken[s] = taken.get(s, 0) + r["taken"]
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(1, 0.02 * t), (s, taken[s], t)


def test_whole_documents(spark):
    """What a pass takes completely comes back with its own text; repeated rows too; runs don't touch within a pass."""
    rows = [(i, f"  d{i}  " + " ".join(f"w{j}" for j in range(i % 40)) + " \n", f"s{i % 2}", 7, "clash") for i in range(60)] + [(3, "twin a b ", "s1", 1, "x"), (3, "twin a b ", "s1", 2, "y"), (None, "n", None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mix_sources(docs, (1, 2, 3), block_words=8)
    got = mixing.mixed_documents(docs, mix).collect()
    taken = {}
    for r in mix.slices.collect():
        taken[r["sid"]] = taken.get(r["sid"], 0) + r["n_words"]
    assert sum(len(r["text"].split()) for r in got) == sum(taken.values())
    passes = [s["quota"] // s["n_blocks"] for s in mix.sources]
    assert max(passes) >= 1
    for i, text, source, size, _ in rows:
        full = sum(1 for r in got if (r["doc_id"], r["text"], r["source"], r["size"]) == (i, text, source, size))
        assert full >= passes[[s["source"] for s in mix.sources].index(source)]
    assert all(any(r["text"] in t for k, t, *_ in rows if k == r["doc_id"]) for r in got)
