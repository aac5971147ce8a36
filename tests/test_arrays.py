import json
import random

import pytest

from lattica.sources import arrays
from lattica.sources.records import read_array, read_records


@pytest.fixture
def small_blocks(spark):
    """Sets the bytes of a block for the time of a test."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


def element(rng, i):
    odd = ['}', '{', ']', '[', ',', '"', "\\", "\\\"", "é日", "\n", '},{"', '\\\\"}]', "plain words"]
    text = "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    kind = rng.random()
    if kind < 0.1:
        return rng.choice([1, -2.5, None, True, "}" + text, [], {}, [text, [1, {"a": [text]}]]])
    return {"id": i, "text": text, "deep": {"x": [[text], {"}": text}]} if kind < 0.5 else None, "list": [text, rng.randrange(99)]}


def plain(values):
    return [(i, json.dumps(v, sort_keys=True)) for i, v in enumerate(values)]


def found(df):
    return [(r["ord"], json.dumps(json.loads(r["raw"]), sort_keys=True)) for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("block", [61, 1_000_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_elements_across_borders(spark, tmp_path, small_blocks, block, indent, monkeypatch):
    monkeypatch.setattr(arrays, "SLICE", 64)
    rng = random.Random(block)
    values = [element(rng, i) for i in range(40)] + [{"long": "},{ \\\" " * 30}, {"last": 1}]
    path = tmp_path / "array.json"
    path.write_text("  " + json.dumps(values, indent=indent, ensure_ascii=rng.random() < 0.5) + "\n \n", encoding="utf-8")
    small_blocks(block)
    assert found(read_array(spark, str(path))) == plain(values)


def test_many_tasks_share_an_array(spark, tmp_path, small_blocks, monkeypatch):
    values = [{"id": i, "text": "w" * (i % 50) + '"}],[{' * (i % 3)} for i in range(20_000)]
    path = tmp_path / "array.json"
    path.write_text(json.dumps(values))
    small_blocks(path.stat().st_size // 16)
    df = read_array(spark, str(path))
    assert arrays.block_states(spark, str(path)).count() >= 16 and df.rdd.getNumPartitions() >= 16
    assert found(df) == plain(values)
    monkeypatch.setattr(arrays, "MOST_BLOCKS", 0)  # states joined by a shuffle
    assert found(read_array(spark, str(path))) == plain(values)


def test_several_files_and_empty_arrays(spark, tmp_path, small_blocks):
    texts = {"a": [{"k": 1}, {"k": 2}], "b": [], "c": [{"k": 3}], "d": ["}"], "e": [0, {"k": "]"}]}
    for name, v in texts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(v))
    small_blocks(5)
    got = found(read_array(spark, str(tmp_path)))
    assert [json.loads(x) for _, x in got] == [{"k": 1}, {"k": 2}, {"k": 3}, "}", 0, {"k": "]"}]
    assert len({o for o, _ in got}) == 6
    (tmp_path / "empty.json").write_text(" [ \n ] ")
    assert read_array(spark, str(tmp_path / "empty.json")).count() == 0


@pytest.mark.parametrize("text", ['[{"a":1}', '[{"a":1},', '{"a":1}', '[{"a":"1}]', '[{"a":1}] [{"b":2}]', '[{"a":1}] 7', '[1,,{"a":2}]', '[{"a":1},]', '[{"a" 1}]', '[{"a":1}}]', "7"])
def test_what_is_no_array_is_refused(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception):
        read_array(spark, str(tmp_path / "bad.json")).collect()


def test_records_by_first_character(spark, tmp_path):
    (tmp_path / "array.json").write_text(' \n [{"a": "[x"}, {"a": 2}]')
    (tmp_path / "lines.json").write_text('{"a": "[x"}\n\n{"a": 2}\n')
    for name in ("array", "lines"):
        assert [json.loads(r["raw"]) for r in read_records(spark, str(tmp_path / f"{name}.json")).orderBy("ord").collect()] == [{"a": "[x"}, {"a": 2}]
    (tmp_path / "scalars.json").write_text('[{"a": 1}, 3]')
    with pytest.raises(Exception, match="no JSON object"):
        read_records(spark, str(tmp_path / "scalars.json")).collect()
