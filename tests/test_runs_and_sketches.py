import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lattica import storage
from lattica.operators import compare, metrics
from lattica.plans import audit


def test_derived_records_follow_the_table(spark, tmp_path):
    """A table that is written anew in one session gives new records."""
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"))
    path = f"{tmp_path}/orders.parquet"
    rows(0, 5).write.parquet(path)
    assert audit.truth(spark, str(tmp_path)).count() == 5
    assert audit.truth(spark, str(tmp_path)).inputFiles() == audit.truth(spark, str(tmp_path)).inputFiles()
    rows(10, 17).write.mode("overwrite").parquet(path)
    assert sorted(r["id"] for r in audit.truth(spark, str(tmp_path)).select("id").collect()) == list(range(10, 17))


def test_one_call_removes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_base", lambda spark: f"file://{tmp_path}/lattica/app")
    for k in range(3):
        assert storage.materialise(spark.range(k + 1)).count() == k + 1
    with storage.scratch(spark):
        storage.materialise(spark.range(2))
    assert len(os.listdir(tmp_path / "lattica" / "app")) == 3
    storage.remove_tables(spark)
    assert not (tmp_path / "lattica" / "app").exists()


def trees(n):
    rng = random.Random(1)
    odd = [0.25, 1, "0.5", " 3e-1 ", "x", "", None, True, False, float("nan"), "inf", "nan", [1], {"a": 1}, -7, "1e999", 12345.678]
    for _ in range(n):
        tree = {}
        paths = [p for _, p, _ in compare.METRICS] + [p for _, p in compare.TEXT_LEVELS] + [f"multilabel_classification.per_class_f1.{t}" for t in ("face_swap", "text_swap")]
        for path in rng.sample(paths, rng.randrange(len(paths))):
            at = tree
            *above, last = path.split(".")
            for key in above:
                at = at.setdefault(key, {})
            if isinstance(at, dict):
                at[last] = rng.choice(odd)
        yield tree


def test_metrics_of_many_runs(spark):
    """The table of all runs' metrics against one run at a time."""
    docs = [json.loads(json.dumps(t).replace("NaN", '"nan"')) for t in trees(40)]
    runs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "run long, document string")
    got = {(r["run"], r["metric"], r["higher"]): r["value"] for r in compare.metric_rows(runs).collect()}
    want = {(i, r["metric"], r["higher"]): r["value"] for i, d in enumerate(docs) for r in compare.metric_table(spark, d).collect()}
    assert got == pytest.approx(want) and sum(v is not None for v in want.values()) > 100


def test_report_lines(spark):
    docs = list(trees(24))
    runs = [spark.createDataFrame([(i // 2, json.dumps(d).replace("NaN", '"nan"')) for i, d in enumerate(docs) if i % 2 == k], "run long, document string") for k in (0, 1)]
    done = compare.compare_metrics(*(compare.metric_rows(r) for r in runs), by=("run",)).where("comparison is not null and not startswith(metric, 'text_f1')")
    got = {(r["run"], r["line"]) for r in done.select("run", compare.report_line(F.col("metric"), F.col("comparison")).alias("line")).collect()}
    want = {(i, line) for i in range(12) for line in compare.markdown(compare.compare_runs(spark, docs[2 * i], docs[2 * i + 1])).splitlines() if line.startswith("| ") and not line.startswith(("| Metric", "| text_f1"))}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_a_sketch_bounds_its_error(spark, bins):
    rng = random.Random(bins)
    rows = [(rng.choice([0, 1, 1, None]), rng.choice([rng.random(), rng.random() ** 3, 0.5, 0.0, 1.0, None, float("nan")])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "label int, score double")
    clean = df.where("label is not null and score is not null and not isnan(score)")
    exact = metrics.auc(clean).first()["auc"]
    parts = [metrics.score_sketch(df.where(F.coalesce(F.hash("score"), F.lit(0)) % 3 == k), bins=bins) for k in (-2, -1, 0, 1, 2)]
    forward, backward = (metrics.merge_sketches(*p) for p in (parts, parts[::-1]))
    assert sorted(map(tuple, forward.collect())) == sorted(map(tuple, backward.collect())) == sorted(map(tuple, metrics.score_sketch(df, bins=bins).collect()))
    found = metrics.sketch_auc(forward).first()
    assert abs(found["auc"] - exact) <= found["error"] + 1e-12 and found["error"] <= (0.5 if bins == 1 else 0.2)
    none = metrics.sketch_auc(metrics.score_sketch(df.where("label = 1"))).first()
    assert none["auc"] != none["auc"]


def test_a_sketch_of_a_stream(spark, tmp_path):
    """A sketch that a stream keeps as its state is the table's, also after a restart."""
    source = str(tmp_path / "in")
    batches = [spark.range(k * 100, k * 100 + 100).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 37 % 101 / 100.0).alias("score")) for k in range(3)]

    def run():
        stream = spark.readStream.schema("label int, score double").parquet(source)
        query = metrics.score_sketch(stream, bins=16).writeStream.outputMode("complete").format("memory").queryName("sketch").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, spark.table("sketch").collect()))

    for k, b in enumerate(batches):
        b.write.mode("append").parquet(source)
        got = run()
    assert got == sorted(map(tuple, metrics.score_sketch(spark.read.parquet(source), bins=16).collect()))
