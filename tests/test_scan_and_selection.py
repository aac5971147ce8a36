import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import metrics, sampling, scan


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_running_sums_and_ranks(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(-5, 9)) for k in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = {(r["g"], r["k"]): r["v_upto"] for r in scan.running_sums(df, ["g"], [F.col("k").desc()], ["v"], part_rows=part_rows).collect()}
    assert got == {(g, k): sum(w for h, j, w in rows if h == g and j >= k) for g, k, _ in rows}
    ranks = {r["k"]: r["rank"] for r in scan.ranked(df, [F.col("k")], part_rows=part_rows).collect()}
    assert ranks == {k: i + 1 for i, k in enumerate(sorted(ranks))} and len(ranks) == 400
    assert scan.running_sums(df.limit(0), ["g"], [F.col("k")], ["v"]).count() == 0


def test_ranges_follow_the_data(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"))
    sizes = scan.in_ranges(df, [F.col("k")], 100).groupBy(scan.RANGE).count().collect()
    assert scan.range_count(2000, 100) == 20 <= len(sizes) + 1 and max(r["count"] for r in sizes) <= 250
    assert scan.range_count(4000, 100) == 40 and scan.range_count(0) == 1


def test_rank_metrics_over_many_ranges(spark, monkeypatch):
    """The same from one range as from many."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), rng.choice([rng.random(), 0.5, 0.25]), rng.choice("xy")) for i in range(600)]
    df = spark.createDataFrame(rows, "ord long, label int, score double, type string")
    run = lambda: (metrics.auc(df).first()[0], metrics.eer(df).first()[0], sorted(map(tuple, metrics.average_precision(df, by=["type"]).collect())))
    one = run()
    monkeypatch.setattr(scan.running_sums, "__kwdefaults__", {"part_rows": 20})
    many = run()
    assert many[:2] == pytest.approx(one[:2]) and [t for t, _ in many[2]] == ["x", "y"] and [v for _, v in many[2]] == pytest.approx([v for _, v in one[2]])
    pos, neg = ([s for _, y, s, _ in rows if y == k] for k in (1, 0))
    assert one[0] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))


def place(i, seed=42):
    return hashlib.sha256(f"{seed}|{i}".encode()).hexdigest(), str(i)


@pytest.mark.parametrize("bucket_rows", [0, 2, 10_000])
@pytest.mark.parametrize("digits", [1, 4])
def test_selection_by_hash(spark, monkeypatch, bucket_rows, digits):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sampling, "DIGITS", digits)
    rows = [(f"i{k}", "pristine" if k % 3 else "manipulated", k) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, verdict string, _hash long").repartition(4)
    of = lambda v: sorted((i for i, w, _ in rows if w == v), key=place)
    for p, m in ((1, 100), (57, 0), (200, 33), (500, 1)):
        got = sampling.first_by_hash(df, "verdict", {"pristine": p, "manipulated": m, "absent": 5})
        assert got.columns == df.columns
        assert sorted(r["id"] for r in got.collect()) == sorted(of("pristine")[:p] + of("manipulated")[:m])


def test_selection_ranks_no_more_than_a_bucket(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 5 == 0, "pristine").otherwise("manipulated").alias("verdict"))
    plan = sampling.balanced_sample(df, 0.4, 1)._jdf.queryExecution().optimizedPlan().toString()
    below = [b for b in plan.split("\n+- ") if "Window" not in b]
    assert plan.count("Window") <= 1 and below
    assert sampling.balanced_sample(df, 0.4, 1).groupBy("verdict").count().collect()


def test_rows_of_one_key(spark, monkeypatch):
    """A quota that ends among rows of one key takes as many of them as are left."""
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 3)
    df = spark.createDataFrame([("same", "a", k) for k in range(50)] + [("x", "a", 99)], "id string, verdict string, k long")
    for n in (1, 20, 50, 51, 60):
        got = sampling.first_by_hash(df, "verdict", {"a": n}).collect()
        assert len(got) == min(n, 51) and len({r["k"] for r in got}) == len(got)
    assert sampling.first_by_hash(df.limit(0), "verdict", {"a": 3}).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_permutation_is_the_list_shuffle(spark, n):
    want = list(range(n))
    random.Random(7).shuffle(want)
    assert [r["number"] for r in sampling.permutation(spark, n, 7).orderBy("place").collect()] == want


def test_exact_order_of_many_rows(spark):
    n = 100_000
    want = [5 * k + 3 for k in range(n)]
    random.Random(11).shuffle(want)
    df = spark.range(n).select((F.col("id") * 5 + 3).alias("ord"), F.lit("x").alias("place"), F.col("id").alias("number")).repartition(8)
    got = sampling.shuffled_head_exact(df, 0, 11)
    assert [r["ord"] for r in got.select("ord").collect()] == want
    assert [tuple(r) for r in sampling.shuffled_head_exact(df, 3, 11).collect()] == [(w, "x", (w - 3) // 5) for w in want[:3]]
