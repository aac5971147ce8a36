import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import align, compare, convert, infer, metrics, mining, sampling
from lattica.sources import documents, images, records


def plain_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not pos or not neg:
        return math.nan
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def plain_eer(rows):
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    if not p or not n:
        return math.nan
    points = [(0.0, 0.0)] + [(sum(s >= c and not y for y, s in rows) / n, sum(s >= c and y for y, s in rows) / p) for c in sorted({s for _, s in rows}, reverse=True)]
    for (f0, t0), (f1, t1) in zip(points, points[1:]):
        a, b = 1 - t0 - f0, 1 - t1 - f1
        if a * b <= 0:
            return f0 + (a / (a - b) if a != b else 0) * (f1 - f0)


def plain_ap(rows):
    hits, total = 0, 0.0
    for rank, (y, _) in enumerate(sorted(rows, key=lambda r: -r[1]), 1):
        hits += y
        total += hits / rank if y else 0
    return total / hits if hits else math.nan


@pytest.mark.parametrize("mode", ["ties", "continuous", "one value", "one class", "empty"])
def test_rank_metrics(spark, mode, monkeypatch):
    monkeypatch.setattr(metrics, "TIE_ROWS", 16)
    rng = random.Random(7)
    draw = {"ties": lambda: rng.randrange(5) / 4, "continuous": rng.random, "one value": lambda: 0.5, "one class": rng.random, "empty": rng.random}[mode]
    rows = [(0 if mode == "one class" else rng.randrange(2), draw()) for _ in range(0 if mode == "empty" else 300)]
    df = spark.createDataFrame([(y, s, i) for i, (y, s) in enumerate(rows)], "label int, score double, ord long")
    same = lambda a, b: (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-12)
    assert same(metrics.auc(df).first()[0], plain_auc(rows))
    assert same(metrics.eer(df).first()[0], plain_eer(rows))
    assert same(metrics.average_precision(df).first()[0], plain_ap(rows))


def test_confusion_and_rates(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, None), (0, None), (0, 0), (0, 1)], "label int, predicted int")
    r = metrics.rates(metrics.confusion(df)).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (1, 1, 2, 2) and r["accuracy"] == pytest.approx(1 / 3)
    none = metrics.rates(metrics.confusion(df.limit(0))).first()
    assert none["accuracy"] == 0.0 and none["f1"] == 0.0


def test_align(spark):
    truth = spark.createDataFrame([("1", 0, "a"), ("2", 1, "b"), ("2", 2, "c")], "id string, ord long, v string")
    pred = lambda *ids: spark.createDataFrame([(i, n, f"r{n}") for n, i in enumerate(ids)], "id long, ord long, response string")
    got = align.align(truth, pred(2, 1, 9)).orderBy("ord").collect()
    assert [r["response"] for r in got] == ["r1", "r0", "r0"] and got[0]["pred_id"] == 1
    with pytest.raises(ValueError, match="not unique"):
        align.align(truth, pred(1, 2, 2))
    with pytest.raises(ValueError, match="1 ids have no prediction, the first of them 1"):
        align.align(truth, pred(2))
    with pytest.raises(ValueError, match="lack ids"):
        align.align(truth, pred(1, None))
    with pytest.raises(ValueError, match="positions"):
        align.align(truth, pred(1, None), allow_positional=True)
    assert [r["response"] for r in align.align(truth, pred(5, None, 7), allow_positional=True).orderBy("ord").collect()] == ["r0", "r1", "r2"]
    assert [r["id"] for r in align.pending(truth, pred(2, None)).collect()] == ["1"]
    rows = truth.withColumns({"split": F.lit("train"), "pool": F.when(F.col("id") == "1", "preference_pool")})
    assert align.require_train_pool(rows.where("id = '1'")).count() == 1
    with pytest.raises(ValueError, match=r"\['2', '2'\]"):
        align.require_train_pool(rows)
    with pytest.raises(ValueError, match="empty"):
        align.require_rows(truth.limit(0), "truth")
    assert align.validate_outputs(truth, truth).first()["ok"] is False and align.validate_outputs(truth.where("ord < 2"), truth.where("ord < 2")).first()["ok"]


def annotation(i):
    names = ["orig", "face_swap", "face_attribute", "text_swap", "text_attribute", "face_swap&text_swap"]
    return {"id": f"news-{i}", "image": f"train_{i}.jpg", "text": f"Person number {i} appears in the city today.", "fake_cls": names[i % 6], "fake_image_box": [8, 4, 40, 28], "fake_text_pos": [2]}


def test_splits_and_samples(spark):
    f = spark.createDataFrame([("news-0",), ("news-1",)], "k string").select(sampling.stable_fraction(F.col("k"))).collect()
    assert [r[0] for r in f] == [0.34022576321943787, 0.8278744225653473]
    rows = spark.createDataFrame([(i, f"news-{i}", "pristine" if i % 6 == 0 else "manipulated") for i in range(60)], "ord long, id string, verdict string")
    pooled = sampling.with_pool(rows, F.col("id"), 0.2)
    assert sorted(r["ord"] for r in pooled.where("pool = 'preference_pool'").collect()) == [8, 9, 12, 27, 32, 36, 48, 53, 58, 59]
    rest = pooled.where("pool = 'sft_train'")
    exact = [r["ord"] for r in sampling.balanced_sample_exact(rest, 0.5, 42).collect()]
    assert exact == [54, 2, 50, 10, 30, 6, 24, 38, 42, 7, 46, 3, 18, 0]
    hashed = sampling.balanced_sample(rest, 0.5, 42).collect()
    assert len(hashed) == 14 and sum(r["verdict"] == "pristine" for r in hashed) == 7
    with pytest.raises(ValueError):
        sampling.balanced_sample(rest.where("verdict = 'pristine'"))
    assert sampling.quotas(10, 1000, 0.4) == (10, 15)
    assert sampling.shuffled_head(rows, 5).count() == 5 and sampling.shuffled_head(rows, 0).count() == 60
    want = list(range(60))
    random.Random(3).shuffle(want)
    assert [r["ord"] for r in sampling.shuffled_head_exact(rows, 7, 3).collect()] == want[:7]


def test_mining_order(spark):
    bad = spark.createDataFrame([(1, [("gpt", "x")])], "id int, conversations array<struct<`from`:string,value:string>>")
    with pytest.raises(Exception, match="no human turn"):
        mining.policy_prompts(bad).collect()


def test_compare(spark):
    tree = lambda auc, eer, bad, f1=0.5: {"binary_classification": {"auc": auc, "eer": eer}, "badcase_analysis": {"badcase_rate": bad}, "text_grounding": {"word_level": {"f1": f1}}, "multilabel_classification": {"map": math.nan, "per_class_f1": {"face_swap": 0.1}}}
    got = compare.compare_runs(spark, tree(0.5, 0.2, 0.5), tree(1.0, 0.2, 0.0), "base", "tuned")
    m = got["metrics"]
    assert m["binary_auc"]["absolute_delta"] == 0.5 and m["binary_auc"]["relative_error_reduction"] == 1.0 and m["badcase_rate"]["relative_error_reduction"] == 1.0
    assert m["binary_eer"]["improved"] is False and m["text_f1"]["mode"] == "word_level_fallback" and "multilabel_map" in got["missing_or_incompatible"] and "face_swap_f1" in m
    assert got["summary"] == {"compared_count": 5, "improved_count": 2}
    assert "| binary_auc | 0.500000 | 1.000000 | +0.500000 | yes | 100.00% |" in compare.markdown(got)
    other = tree(1.0, 0.2, 0.0) | {"text_grounding": {"official_bert_token_level": {"f1": 0.9}}}
    assert "text_f1" in compare.compare_runs(spark, tree(0.5, 0.2, 0.5), other)["missing_or_incompatible"]
    assert compare.nested_value({"a": {"b": "1.5"}}, "a.b") == 1.5 and compare.nested_value({"a": None}, "a") is None and compare.nested_value({"a": "inf"}, "a") is None


def test_documents(tmp_path):
    text = "# top\nmodel: a\n  model: inner\nlr: 1e-4 # x\nmodel: again\n"
    assert documents.patch_settings(text, {"model": "b", "new": "1"}) == "# top\nmodel: b\n  model: inner\nlr: 1e-4 # x\nmodel: again\n\n### runtime overrides\nnew: 1\n"
    assert documents.overrides(["a = b=c", "x="]) == {"a": "b=c", "x": ""}
    for bad in ("novalue", "=x"):
        with pytest.raises(ValueError):
            documents.overrides([bad])
    assert [documents.report_targets(x) for x in ("None", "a, b,", "wandb")] == [[], ["a", "b"], "wandb"]
    documents.register(tmp_path / "info.json", "mine", "m.jsonl")
    documents.register(tmp_path / "info.json", "other", "o.jsonl")
    assert set(documents.read_json(tmp_path / "info.json")) == {"mine", "other"}
    found = documents.registry("p")
    assert len(found) == 6 and found["p_badcase_preference"]["ranking"] and "ranking" not in found["p_val"]
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        documents.read_json(tmp_path / "list.json")


def test_record_files(spark, tmp_path):
    rows = [{"id": 1, "x": "é\n"}, {"id": "s", "y": None}, {"id": None}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows[:2]) + "\n\n  \n" + json.dumps(rows[2]) + "\n", encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1, ensure_ascii=False), encoding="utf-8")
    for name in ("a.jsonl", "a.json"):
        got = records.read_records(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [json.loads(r["raw"]) for r in got] == rows and [r["ord"] for r in got] == [0, 1, 2]
    (tmp_path / "bad.jsonl").write_text("[1]\n" if False else '{"a":1}\n2\n')
    with pytest.raises(Exception, match="no JSON object"):
        records.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "empty.jsonl").write_text("")
    assert records.read_records(spark, str(tmp_path / "empty.jsonl")).count() == 0
    big = spark.range(5000).selectExpr("id", "repeat('z', 50) AS z")
    assert records.write_lines(big.repartition(3), str(tmp_path / "out")) == 5000
    back = records.read_records(spark, str(tmp_path / "out"))
    assert sorted(r["ord"] for r in back.collect()) == list(range(5000))
    assert records.write_lines(big.limit(2), str(tmp_path / "out"), append=True) == 2


def test_uid_bytes():
    a = annotation(1) | {"text": "é \"q\"\x1f", "extra": 1}
    assert convert.uid_of("train", 3, a) == convert.uid_of("train", 3, dict(reversed(a.items()))) and convert.uid_of("train", 4, a) != convert.uid_of("train", 3, a)


def test_images(spark, tmp_path):
    root = tmp_path / "Data"
    (root / "sub").mkdir(parents=True)
    write_png(root / "sub" / "a.png", 64, 32)
    write_png(root / "b.png", 5, 6)
    (tmp_path / "c.png").write_bytes((root / "b.png").read_bytes())
    df = spark.createDataFrame([(0, "sub/a.png"), (1, "data/b.png"), (2, "c.png")], "ord long, image string")
    listing = images.list_images(spark, str(tmp_path))
    got = images.resolve(df, listing, str(root)).withColumn("s", images.image_size(F.col("content"))).orderBy("ord").collect()
    assert [(r["image_path"], r["s"]["width"], r["s"]["height"]) for r in got] == [(str(root / "sub/a.png"), 64, 32), (str(root / "b.png"), 5, 6), (str(tmp_path / "c.png"), 5, 6)]
    assert images.candidates("/x/Data", "data/b.png") == ["/x/Data/data/b.png", "/x/Data/b.png", "/x/data/b.png"]
    with pytest.raises(Exception, match="no such image"):
        images.resolve(spark.createDataFrame([(0, "nope.png")], "ord long, image string"), listing, str(root)).collect()
    whole = (root / "b.png").read_bytes()
    assert images.whole(whole) and not images.whole(whole[:-5]) and images.header_size(b"GIF89a\x05\0\x06\0") == (5, 6)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x20\0\x40" + b"\0" * 9
    assert images.header_size(jpeg) == (64, 32)
    with pytest.raises(ValueError):
        images.header_size(b"???")


def write_png(path, width, height):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_models(spark):
    tokens = spark.createDataFrame([(1, "no", -1.0), (1, "no", -3.0), (1, "yes", -1.0), (2, "yes", -1.0)], "id int, candidate string, logprob double")
    got = {r["id"]: r["score"] for r in infer.candidate_scores(tokens, "no", "yes").collect()}
    assert got[1] == pytest.approx(1 / (1 + math.exp(-1))) and got[2] is None
    assert {(r["id"], r["candidate"]): r["mean_logprob"] for r in infer.mean_logprobs(tokens).collect()}[1, "no"] == -2.0
    rows = spark.createDataFrame([(i, f" p{i} ") for i in range(10)], "id int, prompt string")
    sizes = infer.predict(rows.coalesce(1), lambda: lambda asked: [f"{len(asked)} "] * len(asked), batch=4).collect()
    assert [r["response"] for r in sizes] == ["4"] * 8 + ["2"] * 2
    for wrong in ({"batch": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            infer.predict(rows, lambda: list, **wrong)
