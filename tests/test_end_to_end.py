import json
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lattica import cli
from lattica.plans.oracles import ORACLE_SQL
from lattica.plans.queries import QUERIES
from tests.test_operators import annotation, write_png

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def lines(folder):
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return [json.loads(x) for n in names for x in open(os.path.join(folder, n), encoding="utf-8")]


def test_chain(spark, tmp_path):
    """Convert, mine, prompts, evaluate, score and compare on synthetic annotations."""
    meta, root, out = tmp_path / "meta", tmp_path / "images", tmp_path / "out"
    meta.mkdir()
    root.mkdir()
    for split, first, n in (("train", 0, 60), ("val", 1000, 12), ("test", 1100, 12)):
        rows = []
        for i in range(n):
            a = annotation(i) | {"id": f"news-{first + i}", "image": f"{split}_{i}.png"}
            write_png(root / a["image"], 64, 32)
            rows.append(a)
        (meta / f"{split}.json").write_text(json.dumps(rows))
    flags = ["--metadata-dir", str(meta), "--image-root", str(root), "--output-dir", str(out), "--preference-pool-ratio", "0.2", "--exact"]
    manifest = cli.main(["convert", *flags], spark)
    sft, pool, test = (lines(out / f"audit_{n}.jsonl") for n in ("sft_train", "preference_pool", "test"))
    assert len(sft) == 14 and len(pool) == 10 and len(test) == 12 and manifest["outputs"]["audit_sft_train"]["verdicts"] == {"manipulated": 7, "pristine": 7}
    assert not {r["meta"]["news_id"] for r in sft} & {r["meta"]["news_id"] for r in pool}
    assert pool[0]["meta"]["target"]["image_bbox"] in (None, [125, 125, 625, 875])

    bad = tmp_path / "bad.jsonl"
    bad.write_text("\n".join(json.dumps({"id": r["id"], "response": "nonsense"}) for r in pool))
    report = cli.main(["mine", "--pool", str(out / "audit_preference_pool.jsonl"), "--predictions", str(bad), "--output", str(tmp_path / "pairs.jsonl"), "--report", str(tmp_path / "report.json")], spark)
    assert report["eligible"] == report["written_pair_count"] == 7 and report["valid_prediction_rate"] == 0.0
    pairs = lines(tmp_path / "pairs.jsonl")
    assert all(p["rejected"]["value"] == "nonsense" and json.loads(p["chosen"]["value"])["verdict"] == "manipulated" and p["meta"]["error_tags"] == ["invalid_json_or_schema"] for p in pairs)
    with pytest.raises(ValueError, match="preference pool"):
        cli.main(["mine", "--pool", str(out / "audit_test.jsonl"), "--predictions", str(bad), "--output", str(tmp_path / "x.jsonl")], spark)

    prompts = cli.main(["prompts", "--source", str(out / "audit_preference_pool.jsonl"), "--output", str(tmp_path / "ppo.jsonl"), "--dataset-info", str(tmp_path / "info.json")], spark)
    assert prompts == {"written": 10} and all(len(r["conversations"]) == 1 for r in lines(tmp_path / "ppo.jsonl"))

    def predict(broken):
        path = tmp_path / f"pred{broken}.jsonl"
        rows = []
        for i, r in enumerate(test):
            t = r["meta"]["target"]
            rows.append({"id": r["id"], "response": "oops" if i == broken else r["conversations"][1]["value"], "manipulated_score": float(t["verdict"] == "manipulated"), "type_scores": {x: float(x in t["types"]) for x in ("face_swap", "face_attribute", "text_swap", "text_attribute")}})
        path.write_text("\n".join(map(json.dumps, rows)))
        return str(path)

    def evaluate(broken):
        name = str(tmp_path / f"metrics{broken}.json")
        return cli.main(["evaluate", "--ground-truth", str(out / "audit_test.jsonl"), "--predictions", predict(broken), "--output", name], spark)

    perfect, flawed = evaluate(-1), evaluate(5)
    assert perfect["json_valid_rate"] == perfect["binary_classification"]["auc"] == perfect["multilabel_classification"]["map"] == perfect["image_grounding"]["mean_iou"] == perfect["text_grounding"]["word_level"]["f1"] == 1.0
    assert perfect["binary_classification"]["eer"] == 0.0 and perfect["badcase_analysis"]["badcase_count"] == 0 and perfect["binary_classification"]["score_mode"] == "continuous"
    assert flawed["binary_classification"]["accuracy"] == 1.0 and flawed["json_valid_rate"] < 1.0 and flawed["structured_output"]["verdict_accuracy"] < 1.0
    change = cli.main(["compare", "--before", str(tmp_path / "metrics5.json"), "--after", str(tmp_path / "metrics-1.json"), "--output", str(tmp_path / "c.json"), "--markdown-output", str(tmp_path / "c.md")], spark)
    assert change["metrics"]["badcase_rate"]["relative_error_reduction"] == 1.0 and (tmp_path / "c.md").read_text().startswith("# before vs after")
    summary = cli.main(["score", "--ground-truth", str(out / "audit_test.jsonl"), "--responses", predict(-1), "--output", str(tmp_path / "rewards.jsonl")], spark)
    assert summary["count"] == 12 and summary["valid_rate"] == 1.0 and summary["mean_penalty"] == 0.0
    (tmp_path / "t.yaml").write_text("a: 1\n")
    cli.main(["settings", "--template", str(tmp_path / "t.yaml"), "--output", str(tmp_path / "o.yaml"), "--set", "a=2"])
    assert (tmp_path / "o.yaml").read_text() == "a: 2\n"


def test_stream(spark, tmp_path):
    from lattica.streaming import scoring

    rows = [{"id": str(i % 4), "response": '{"verdict":"real"}' if i % 2 else "x", "ts": f"2024-01-01T00:0{i}:00", "target": {"verdict": "pristine", "types": [], "image_bbox": None, "text_positions": []}} for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = []
    q = scoring.write_batches(scoring.score_stream(scoring.read_responses(spark, str(tmp_path / "in"))), lambda df, n: got.extend(df.select("id", "errors", "reward").collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["id"]: (r["errors"], r["reward"]) for r in got} == {"0": (["invalid_json_or_schema"], -0.5), "1": ([], 1.0), "2": (["invalid_json_or_schema"], -0.5), "3": ([], 1.0)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    cell = lambda v: "" if v is None or v is pd.NaT else str(bool(v)) if isinstance(v, bool) else f"{float(v):.6f}" if hasattr(v, "__float__") else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_agree_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
