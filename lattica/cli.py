"""Command line: convert, infer, merge, mine, evaluate, score, prompts, compare, settings.

    python -m lattica.cli evaluate --ground-truth truth.jsonl --predictions pred.jsonl --output metrics.json
"""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.parse import parse_response
from .functions.scoring import first_present, given_type_scores, response_text
from .operators import align, compare, convert, infer, metrics, mining, rewards, sampling
from .sources import commits, documents, images, records
from .storage import materialise
from .types import PART_WEIGHTS, RESPONSE_KEYS, SCORE_KEYS, TARGET

META = f"struct<id:string,news_id:string,{{split}}:string,pool:string,fake_cls:string,fake_image_box:array<double>,fake_text_pos:array<int>,normalized_text:string,image_width:int,image_height:int,target:{TARGET.simpleString()}>"
TALK = "array<struct<`from`:string,value:string>>"


def session() -> SparkSession:
    return SparkSession.builder.appName("lattica").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read_truth(spark: SparkSession, path: str, split_field: str) -> DataFrame:
    """ord, id, images, conversations, meta, target and caption of converted records."""
    meta = META.format(split=split_field)
    rows = records.parse_records(records.read_records(spark, path), f"id string, images array<string>, conversations {TALK}, meta {meta}")
    return rows.withColumns({"target": F.col("meta.target"), "caption": F.col("meta.normalized_text")})


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, response, is_object, manipulated_score, type_scores (a map) and type_list, by the presence of keys in each row."""
    raw = F.col("raw")
    value = lambda k: F.get_json_object(raw, f"$.{k}")
    fields = F.from_json(raw, "map<string,variant>")
    is_object = lambda k: F.coalesce(F.schema_of_variant(fields[k]).startswith("OBJECT"), F.lit(False))
    named, listed = given_type_scores(raw)
    return records.read_records(spark, path).select(
        "ord", F.coalesce(value("id"), value("meta.id")).alias("id"), response_text(raw).alias("response"), F.coalesce(first_present(raw, RESPONSE_KEYS, is_object), F.lit(False)).alias("is_object"),
        first_present(raw, SCORE_KEYS, lambda k: value(k).cast("double")).alias("manipulated_score"), named.alias("type_scores"), listed.alias("type_list"),
    )


def read_aligned(spark: SparkSession, truth: str, predictions: str, args: argparse.Namespace) -> DataFrame:
    both = align.align(read_truth(spark, truth, args.split_field), read_predictions(spark, predictions), allow_positional=args.allow_positional)
    return both.withColumn("parsed", parse_response(F.col("response"), is_object=F.col("is_object")))


def run_convert(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    listing = materialise(images.list_sizes(spark, args.image_root, verify=not args.skip_image_check), "sizes")
    out, counts = Path(args.output_dir), {}

    def one(split: str, pool: Any) -> DataFrame:
        rows = sampling.head(records.read_records(spark, f"{args.metadata_dir}/{split}.json"), args.max_samples_per_split or None)
        found = images.resolve(rows.withColumn("image", F.get_json_object("raw", "$.image")), listing, args.image_root)
        size = images.checked(F.col("size"))
        sized = found.select("ord", "raw", "image_path", size["width"].alias("width"), size["height"].alias("height"))
        return convert.convert(sized, split=split, pool=pool, max_words=args.max_words, split_field=args.split_field)

    key = convert.group_key(F.col("raw"), F.col("ord"))
    train = one("train", F.when(sampling.stable_fraction(key, args.seed) < args.preference_pool_ratio, "preference_pool").otherwise("sft_train"))
    sft = train.where("meta.pool = 'sft_train'").withColumn("verdict", F.col("meta.target.verdict"))
    balance = sampling.balanced_sample_exact if args.exact else sampling.balanced_sample
    sets = {"sft_train": balance(sft, args.normal_ratio, args.seed).drop("verdict"), "preference_pool": train.where("meta.pool = 'preference_pool'")} | {s: one(s, "evaluation") for s in ("val", "test")}
    for name, rows in sets.items():
        full = f"{args.prefix}_{name}"
        records.write_lines(rows.drop("ord"), str(out / f"{full}.jsonl"))
        n: dict[str, Any] = {"count": 0, "verdicts": {}, "labels": {}}
        for r in convert.summarize(rows).orderBy("label", "verdict").collect():
            if r["label"] is not None:
                n["labels"][r["label"]] = r["n"]
            elif r["verdict"] is not None:
                n["verdicts"][r["verdict"]] = r["n"]
            else:
                n["count"] = r["n"]
        counts[full] = n
    documents.write_json(out / "dataset_info.json", documents.registry(args.prefix))
    settings = {k: getattr(args, k) for k in ("seed", "max_words", "preference_pool_ratio", "normal_ratio")}
    manifest = documents.run_manifest(settings, {"metadata_dir": args.metadata_dir, "image_root": args.image_root}, counts)
    documents.write_json(out / "manifest.json", manifest)
    return manifest


def run_mine(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    pool = align.require_train_pool(read_truth(spark, args.pool, args.split_field), split=f"meta.{args.split_field}", pool="meta.pool")
    n = pool.count()
    marked = mining.mark_errors(read_aligned(spark, args.pool, args.predictions, args), bbox_threshold=args.bbox_threshold, text_f1_threshold=args.text_f1_threshold, include_pristine=args.include_pristine_errors).persist()
    pairs = mining.preference_pairs(marked, mined_from=args.predictions, max_pairs=args.max_pairs, seed=args.seed, exact=args.exact)
    written = records.write_lines(pairs, args.output)
    report = mining.mining_report(marked).first().asDict()
    tags = {r["tag"]: r["n"] for r in metrics.tag_counts(marked, "error_tags").orderBy("tag").collect()}
    marked.unpersist()
    return {"pool_count": n, **report, "written_pair_count": written, "max_pairs": args.max_pairs, "error_tag_counts_before_cap": tags, "source_split": "train", "include_pristine_errors": args.include_pristine_errors, "leakage_guard": "passed"}


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    scored = metrics.score_rows(read_aligned(spark, args.ground_truth, args.predictions, args), bbox_threshold=args.bbox_threshold, text_f1_threshold=args.text_f1_threshold, binary_threshold=args.binary_threshold, type_threshold=args.type_threshold).persist()
    words = None if args.bert_tokenizer is None else metrics.subword_counts(scored, metrics.word_numbers(args.bert_tokenizer), max_length=args.bert_max_length)
    tree = metrics.evaluate(scored, type_threshold=args.type_threshold, binary_threshold=args.binary_threshold, subwords=words, subword_name=args.bert_tokenizer or "", max_length=args.bert_max_length)
    if args.badcases_output:
        records.write_lines(metrics.bad_cases(scored), args.badcases_output)
    scored.unpersist()
    return tree


def run_score(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    counts = rewards.count_cases(read_truth(spark, args.weights_from or args.ground_truth, args.split_field))
    weights = rewards.case_weights(counts)
    scored = rewards.score_rewards(read_aligned(spark, args.ground_truth, args.responses, args), weights).persist()
    records.write_lines(scored, args.output)
    summary = rewards.reward_summary(scored).first().asDict()
    table = weights.orderBy("case").collect()  # at most eight
    if args.manifest_output:
        made = documents.reward_manifest({"dataset": args.ground_truth, "weights_from": args.weights_from or args.ground_truth}, {r["case"]: r["weight"] for r in table}, {r["case"]: r["n"] for r in table}, summary["count"], PART_WEIGHTS)
        documents.write_json(args.manifest_output, made)
    cases = {r[0]: r[1] for r in scored.groupBy("breakdown.case").count().orderBy("case").collect()}
    scored.unpersist()
    return summary | {"case_counts": cases, "weight_counts": {r["case"]: r["n"] for r in table}, "case_weights": {r["case"]: r["weight"] for r in table}}


def run_prompts(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    rows = sampling.head(read_truth(spark, args.source, args.split_field), args.max_samples)
    rows = align.require_train_pool(rows, split=f"meta.{args.split_field}", pool="meta.pool")
    n = records.write_lines(mining.policy_prompts(rows), args.output)
    documents.register(args.dataset_info, args.dataset_name, Path(args.output).name)
    return {"written": n}


def run_infer(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    """Answers of a model, of the rows of one shard that the output doesn't have yet; ``--committed`` appends them as a batch that counts as a whole or not at all."""
    module, _, name = args.model_factory.partition(":")
    rows = sampling.head(read_truth(spark, args.dataset, args.split_field), args.max_samples)
    if args.shards > 1:
        rows = rows.where(sampling.shard_of(F.col("ord"), args.shards) == args.shard)
    done = records.read_records(spark, args.output).select(F.get_json_object("raw", "$.id").alias("id")) if Path(args.output).exists() else None
    said = infer.predict(infer.prompts(rows), getattr(importlib.import_module(module), name), batch=args.batch_size, mode=args.mode, model=args.model_factory, done=done)
    said = materialise(said, "said")
    if args.committed:
        return {"written": commits.append_batch(said, args.output, commits.next_batch(spark, args.output))}
    return {"written": records.write_lines(said, args.output, append=True)}


def run_merge(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    """Shards of outputs as one file, once they are as many as the rows and of as many ids."""
    parts = materialise(records.union([records.read_records(spark, p) for p in args.inputs.split(",")]), "merged")
    truth = records.read_records(spark, args.ground_truth)
    n = align.require_valid_outputs(truth, parts.withColumn("id", F.get_json_object("raw", "$.id")))
    parts.select(F.col("raw").alias("value")).write.mode("overwrite").text(args.output)
    return {"written": n}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str, **optional: Any) -> None:
        p = sub.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            flag = f"--{n.replace('_', '-')}"
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=type(default) if default is not None else (int if n in ("max_samples", "max_samples_per_split") else str))
        p.add_argument("--split-field", default="split", help="the meta field that names the official split")

    tags = {"bbox_threshold": 0.5, "text_f1_threshold": 1.0, "allow_positional": False}
    command("convert", "metadata-dir", "image-root", "output-dir", preference_pool_ratio=0.10, normal_ratio=0.50, max_words=50, seed=42, max_samples_per_split=None, skip_image_check=False, prefix="audit", exact=False)
    command("mine", "pool", "predictions", "output", report=None, max_pairs=5000, seed=42, include_pristine_errors=False, exact=False, **tags)
    command("evaluate", "ground-truth", "predictions", "output", badcases_output=None, binary_threshold=0.5, type_threshold=0.5, bert_tokenizer=None, bert_max_length=128, **tags)
    command("infer", "dataset", "output", "model-factory", mode="full", batch_size=16, shards=1, shard=0, max_samples=None, committed=False)
    command("merge", "ground-truth", "inputs", "output")
    command("score", "ground-truth", "responses", "output", summary_output=None, manifest_output=None, weights_from=None, allow_positional=False)
    command("prompts", "source", "output", "dataset-info", dataset_name="audit_ppo_train", max_samples=None)
    command("compare", "before", "after", "output", before_name="before", after_name="after", markdown_output=None)
    p = sub.add_parser("settings")
    p.add_argument("--template", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--set", dest="sets", action="append", default=[], metavar="KEY=VALUE")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    args = parser().parse_args(argv)
    if args.command == "settings":
        documents.write_text(args.output, documents.patch_settings(Path(args.template).read_text(encoding="utf-8"), documents.overrides(args.sets)))
        return {"output": args.output}
    spark = spark or session()
    if args.command == "compare":
        found = compare.compare_runs(spark, documents.read_json(args.before), documents.read_json(args.after), args.before_name, args.after_name)
        if args.markdown_output:
            documents.write_text(args.markdown_output, compare.markdown(found))
    else:
        run = {"convert": run_convert, "mine": run_mine, "evaluate": run_evaluate, "score": run_score, "prompts": run_prompts, "infer": run_infer, "merge": run_merge}[args.command]
        found = run(spark, args)
    target = {"compare": "output", "evaluate": "output", "mine": "report", "score": "summary_output"}.get(args.command)
    if target and getattr(args, target, None):
        documents.write_json(getattr(args, target), found)
    return found


if __name__ == "__main__":
    print(json.dumps(main(), ensure_ascii=False, indent=2))
