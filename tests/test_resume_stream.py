import json

import pytest
from pyspark.sql import functions as F

from lattica.sources import commits, records
from lattica.streaming import resume


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    resume.use_state_store(spark)
    yield
    spark.conf.set(name, old)


def outputs(spark, path):
    return sorted((str(json.loads(r["raw"]).get("id")), json.loads(r["raw"])["text"]) for r in records.read_records(spark, path).collect())


def test_ids_are_predicted_once(spark, tmp_path, state_store):
    """Restarts from the checkpoint, after a failure, and without a checkpoint."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    seen = spark.sparkContext.accumulator(0)

    def put(rows):
        spark.createDataFrame(rows, "id string, text string").coalesce(1).write.mode("append").json(source)

    def predict(batch, fail=False):
        batch.foreach(lambda r: seen.add(1))
        return batch.withColumn("text", F.when(F.lit(fail) & (F.col("id") == "e"), F.raise_error(F.lit("killed")).cast("string")).otherwise(F.upper("text")))

    def run(checkpoint, **settings):
        stream = spark.readStream.schema("id string, text string").json(source)
        query = resume.predict_stream(stream, lambda b: predict(b, **settings), path, str(tmp_path / checkpoint))
        query.awaitTermination()

    put([("a", "x"), ("b", "y"), ("a", "x again")])
    run("one")
    first = outputs(spark, path)
    assert [i for i, _ in first] == ["a", "b"] and first[1] == ("b", "Y") and seen.value == 2
    put([("b", "late"), ("c", "z"), ("d", "d")])
    run("one")  # from the checkpoint
    assert [i for i, _ in outputs(spark, path)] == ["a", "b", "c", "d"] and seen.value == 4
    put([("e", "e"), ("f", "f"), ("a", "later")])
    with pytest.raises(Exception, match="killed"):
        run("one", fail=True)
    assert [i for i, _ in outputs(spark, path)] == ["a", "b", "c", "d"]
    run("one")  # the failed batch again
    assert [i for i, _ in outputs(spark, path)] == ["a", "b", "c", "d", "e", "f"]
    before, batches = seen.value, len(commits.commits(spark, path))
    put([("g", "g"), ("f", "later"), (None, "unnamed")])
    run("two")  # the checkpoint is lost: all of the source comes again, its ids are known from the outputs
    got = outputs(spark, path)
    assert [i for i, _ in got] == ["None", "a", "b", "c", "d", "e", "f", "g"] and seen.value == before + 2
    assert len(commits.commits(spark, path)) > batches and ("f", "F") in got
