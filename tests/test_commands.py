"""Commands that test_chain doesn't run: listed scores, sub-words, inference in shards, merging, manifests."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lattica import cli
from lattica.functions import scoring
from lattica.operators import infer, metrics, mining, rewards
from lattica.sources import documents, images, records
from lattica.types import TARGET
from tests.test_end_to_end import lines
from tests.test_operators import write_png

TYPES = ("face_swap", "face_attribute", "text_swap", "text_attribute")


@pytest.fixture()
def truth(tmp_path):
    """Six records; the odd ones are manipulated by a swapped second word."""
    rows = []
    for i in range(6):
        fake = i % 2 == 1
        target = {"verdict": "manipulated" if fake else "pristine", "types": ["text_swap"] if fake else [], "image_bbox": None, "text_positions": [1] if fake else []}
        meta = {"id": f"r{i}", "news_id": "", "split": "train", "pool": "preference_pool", "fake_cls": "text_swap" if fake else "orig", "fake_text_pos": [], "normalized_text": "ab cd ef", "image_width": 1, "image_height": 1, "target": target}
        talk = [{"from": "human", "value": "<image>\nask"}, {"from": "gpt", "value": json.dumps(target)}]
        rows.append({"id": f"r{i}", "images": ["i.png"], "conversations": talk, "meta": meta})
    path = tmp_path / "truth.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path), rows


def test_listed_scores_and_subwords(spark, truth, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path, rows = truth
    pieces = Tokenizer(models.WordPiece({"[UNK]": 0, "a": 1, "##b": 2, "cd": 3, "e": 4, "##f": 5}, unk_token="[UNK]"))
    pieces.pre_tokenizer = pre_tokenizers.Whitespace()
    pieces.save(str(tmp_path / "pieces.json"))
    said = []
    for i, r in enumerate(rows):
        fake = i % 2 == 1
        answer = r["meta"]["target"] | ({"text_positions": [0, 1]} if i == 1 else {})
        scores = [0.1, 0.2, 0.9 if fake else 0.3, 0.0] if i % 3 else {"text_swap": 0.8 if fake else 0.4}
        said.append({"id": r["id"], "prediction": json.dumps(answer), "score": 0.9 if fake else 0.2, "type_scores": scores})
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, said)))
    tree = cli.main(["evaluate", "--ground-truth", path, "--predictions", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "m.json"), "--bert-tokenizer", str(tmp_path / "pieces.json")], spark)
    assert tree["multilabel_classification"]["score_mode"] == "continuous" and tree["multilabel_classification"]["per_class_ap"]["text_swap"] == 1.0
    assert tree["multilabel_classification"]["per_class_f1"]["text_swap"] == 1.0
    level = tree["text_grounding"]["official_bert_token_level"]
    # r1 also says word 0, which has two sub-words; the swapped words have one each
    assert (level["tp"], level["fp"], level["fn"], level["tn"]) == (3, 2, 0, 30 - 5)
    assert tree["official_metrics_percent"]["F1_tok"] == pytest.approx(100 * 6 / 8)


def test_infer_in_shards_merge_and_manifest(spark, truth, tmp_path):
    path, rows = truth
    outs = [str(tmp_path / f"shard{i}") for i in range(2)]
    for i, out in enumerate(outs):
        flags = ["infer", "--dataset", path, "--output", out, "--model-factory", "tests.stub_model:Weighing", "--shards", "2", "--shard", str(i)]
        assert cli.main(flags, spark) == {"written": 3} and cli.main(flags, spark) == {"written": 0}  # resumed: nothing is left
    row = lines(outs[0])[0]
    assert row["score_method"] == infer.SCORE_METHODS["full"] and row["manipulated_score"] == pytest.approx(1 / (1 + math.exp(-1))) and list(row["type_scores"]) == list(TYPES)
    merged = str(tmp_path / "merged")
    assert cli.main(["merge", "--ground-truth", path, "--inputs", ",".join(outs), "--output", merged], spark) == {"written": 6}
    with pytest.raises(ValueError, match="outputs don't match: 6 rows, 3 outputs of 3 ids"):
        cli.main(["merge", "--ground-truth", path, "--inputs", outs[0], "--output", str(tmp_path / "x")], spark)
    with pytest.raises(ValueError, match="6 outputs of 3 ids"):
        cli.main(["merge", "--ground-truth", path, "--inputs", f"{outs[0]},{outs[0]}", "--output", str(tmp_path / "x")], spark)
    cli.main(["score", "--ground-truth", path, "--responses", merged, "--output", str(tmp_path / "r"), "--manifest-output", str(tmp_path / "man.json")], spark)
    made = documents.read_json(tmp_path / "man.json")
    assert made["case_counts"] == {"normal": 3, "text_swap": 3} and made["num_samples"] == 6 and made["reward"] == "weight * (0.5 verdict + 0.25 types + 0.25 evidence) - penalty"


def test_modes_that_need_scores(spark):
    rows = spark.createDataFrame([(1, "p")], "id int, prompt string")
    with pytest.raises(ValueError, match="needs columns"):
        infer.predict(rows, lambda: None, mode="full")
    asked = rows.withColumn("verdict_prompt", F.lit("v"))
    with pytest.raises(Exception, match="mean_logprobs"):
        infer.predict(asked, lambda: lambda a: ["x"] * len(a), mode="binary").collect()


def test_presence_decides(spark):
    raws = ['{"response":null,"output":"o"}', '{"output":"o"}', '{"predict":"p","response":"r"}', '{"prediction":{"a":1}}']
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(scoring.response_text(F.col("raw")).alias("t")).collect()
    assert [r["t"] for r in got] == ["None", "o", "r", '{"a":1}']
    with pytest.raises(Exception, match="none of"):
        spark.createDataFrame([('{"x":1}',)], "raw string").select(scoring.response_text(F.col("raw"))).collect()


def test_targets_of_rows_and_empty_counts(spark):
    kind = f"target {TARGET.simpleString()}, meta struct<target:{TARGET.simpleString()}>"
    fake, real = ("manipulated", ["face_swap"], None, []), ("pristine", [], None, [])
    rows = spark.createDataFrame([(fake, None), (None, (fake,)), (None, (real,)), (real, (fake,))], kind)
    assert {r["case"]: r["n"] for r in rewards.count_cases(rows).collect()} == {"face_swap": 2, "normal": 2}
    with pytest.raises(Exception, match="neither target"):
        rewards.count_cases(spark.createDataFrame([(fake, None), (None, (None,))], kind)).collect()
    with pytest.raises(Exception, match="no case has a count"):
        rewards.case_weights(spark.createDataFrame([("normal", 0)], "case string, n long")).collect()


def test_damaged_images_matter_where_they_are_used(spark, tmp_path):
    write_png(tmp_path / "a.png", 4, 3)
    (tmp_path / "b.png").write_bytes(b"junk")
    sizes = images.list_sizes(spark, str(tmp_path))
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "image string")
    good = images.resolve(rows("a.png", "a.png"), sizes, str(tmp_path)).select(images.checked(F.col("size")).alias("s")).collect()
    assert [tuple(r["s"]) for r in good] == [(4, 3)] * 2
    with pytest.raises(Exception, match="no image header"):
        images.resolve(rows("b.png"), sizes, str(tmp_path)).select(images.checked(F.col("size"))).collect()
    with pytest.raises(Exception, match="no such image: null"):
        images.resolve(rows(None), sizes, str(tmp_path)).collect()


def test_record_splits_and_windows(spark, tmp_path):
    from lattica.streaming import scoring as streaming

    for s, n in (("train", 3), ("val", 1), ("test", 2)):
        (tmp_path / f"{s}.json").write_text(json.dumps([{"id": f"{s}{i}"} for i in range(n)]))
    got = records.read_splits(spark, str(tmp_path)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 3, "val": 1, "test": 2}
    errors = spark.createDataFrame([("2024-01-01 00:01:00", ["a", "b"]), ("2024-01-01 00:09:00", ["a"]), ("2024-01-01 00:11:00", [])], "ts string, errors array<string>").withColumn("ts", F.to_timestamp("ts"))
    assert {(r["tag"], r["n"]) for r in streaming.error_windows(errors).collect()} == {("a", 2), ("b", 1)}
    talk = "array<struct<`from`:string,value:string>>"
    rows = spark.createDataFrame([(1, [("human", "<image>\nask")], ["a", "b"], ("cap",))], f"id int, conversations {talk}, images array<string>, meta struct<normalized_text:string>")
    assert rows.select(mining.first_user_prompt(F.col("conversations"), F.col("id")).alias("p")).first()["p"] == "ask"
    asked = infer.prompts(rows).first()
    assert asked["prompt"] == "ask" and asked["verdict_prompt"].startswith("News text: cap\n") and len(asked["type_prompts"]) == 4
    assert metrics.word_numbers  # a tokenizer's file is read in test_listed_scores_and_subwords
