import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from lattica.sources import commits, images, records


def ids(spark, path):
    return sorted(json.loads(r["raw"])["id"] for r in records.read_records(spark, path).collect())


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda lo, hi: spark.range(lo, hi)
    assert not commits.is_log(spark, path) and commits.commits(spark, path) == {} and commits.next_batch(spark, path) == "00000000"
    assert commits.append_batch(rows(0, 5), path, "a") == 5
    assert commits.append_batch(rows(5, 7), path, "b") == 2
    assert commits.append_batch(rows(100, 900), path, "a") == 5  # nothing is written again
    assert ids(spark, path) == list(range(7))
    got = records.read_records(spark, path)
    assert sorted(r["ord"] for r in got.collect()) == list(range(7))
    assert commits.append_batch(rows(0, 0), path, "c") == 0 and commits.next_batch(spark, path) == "00000003"
    with pytest.raises(ValueError):
        commits.append_batch(rows(0, 1), path, "../x")


def test_a_batch_that_was_cut_off(spark, tmp_path):
    """A writer that dies half way, before or after its files, leaves nothing to be seen; the next one adds all."""
    path = str(tmp_path / "out")
    commits.append_batch(spark.range(3), path, "a")
    broken = spark.range(3, 9, 1, 3).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        commits.append_batch(broken, path, "b")
    records.write_lines(spark.range(3, 9), f"{path}/b-attempt")  # written, never committed
    with open(os.path.join(path, "_commits", ".b-attempt"), "w") as f:
        f.write('{"folder"')
    assert ids(spark, path) == [0, 1, 2]
    for _ in range(2):
        assert commits.append_batch(spark.range(3, 9), path, "b") == 6
        assert ids(spark, path) == list(range(9))


def test_of_two_writers_one_counts(spark, tmp_path):
    path = str(tmp_path / "out")
    for name, n in (("b-1", 4), ("b-2", 6)):
        records.write_lines(spark.range(n), f"{path}/{name}")
    assert commits.commit(spark, path, "b", "b-1", 4) == 4 and commits.commit(spark, path, "b", "b-2", 6) == 4
    assert ids(spark, path) == [0, 1, 2, 3]


def test_infer_appends_committed_batches(spark, tmp_path):
    from lattica import cli

    target = {"verdict": "pristine", "types": [], "image_bbox": None, "text_positions": []}
    rows = [{"id": f"r{i}", "images": ["i.png"], "conversations": [{"from": "human", "value": "<image>\nask"}], "meta": {"id": f"r{i}", "normalized_text": "a b", "target": target}} for i in range(5)]
    truth, out = tmp_path / "truth.jsonl", str(tmp_path / "out")
    flags = ["infer", "--dataset", str(truth), "--output", out, "--model-factory", "tests.stub_model:Weighing", "--committed"]
    for n, written in ((3, 3), (3, 0), (5, 2)):
        truth.write_text("\n".join(map(json.dumps, rows[:n])))
        assert cli.main(flags, spark) == {"written": written}
        records.write_lines(spark.range(4).selectExpr("'r4' AS id"), f"{out}/left-behind-{n}")  # of a run that was cut off
    assert ids(spark, out) == [f"r{i}" for i in range(5)]
    assert cli.main(["merge", "--ground-truth", str(truth), "--inputs", out, "--output", str(tmp_path / "merged")], spark) == {"written": 5}


def jpeg(width, height, before):
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    frame = segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes(9))
    return b"\xff\xd8" + b"".join(segment(0xE1, bytes([k % 256]) * 60_000) for k in range(before)) + b"\xff\xff" * 3 + frame + bytes(300_000) + b"\xff\xd9"


@pytest.mark.parametrize("before", [0, 1, 20])
def test_headers_are_read_by_ranges(before):
    data, read = jpeg(640, 480, before), []

    def some(at, n):
        read.append(min(n, max(0, len(data) - at)))
        return data[at : at + n]

    assert images.header_size(some) == images.header_size(data) == (640, 480)
    assert sum(read) <= images.HEAD * (before + 2) and len(data) > 300_000 + 60_000 * before


def test_sizes_of_files_by_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"a.jpg": jpeg(640, 480, 3), "b.jpg": jpeg(3, 4, 0)[:-2], "c.gif": b"GIF89a" + struct.pack("<HH", 7, 9) + bytes(50), "d.bin": b"nothing", "e.jpg": b"\xff\xd8\xff\xe1\xff\xff", "in/f.bmp": b"BM" + bytes(16) + struct.pack("<ii", 5, -6) + bytes(9)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.relpath(r["path"], tmp_path): (r["size"]["width"], r["size"]["height"]) for r in images.list_sizes(spark, str(tmp_path), verify=False).collect()}
    assert got == {"a.jpg": (640, 480), "b.jpg": (3, 4), "c.gif": (7, 9), "d.bin": (None, None), "e.jpg": (None, None), "in/f.bmp": (5, 6)}
    whole = {os.path.relpath(r["path"], tmp_path): (r["size"]["width"], r["size"]["height"]) for r in images.list_sizes(spark, str(tmp_path)).collect()}
    assert whole == got | {"b.jpg": (None, None)}  # its end is missing
    plan = images.list_sizes(spark, str(tmp_path), verify=False)._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan
