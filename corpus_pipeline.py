"""A corpus pipeline out of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return documents. What a stage learns, it learns from the labels of documents
that have come to it. Null texts have no words: the quality rules reject them. Columns of
documents stay what they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, packing, quality, simhash, toxicity
from lattica.llm.common import load, scratch, shared_dir
from lattica.llm.tokens import tokenizer_path

#: A document goes if it is toxic with at least this probability.
TOXIC = 0.7
#: Words of a block of the mix: several documents, so that few are cut. Small sources have smaller blocks.
BLOCK_WORDS = 2048
#: Names of what stages add for a while; documents with such columns are refused.
STATISTIC, SCORE = "_pipeline_statistic_", "_pipeline_score"


def _checked(docs: DataFrame) -> DataFrame:
    if taken := [c for c in docs.columns if c.lower().startswith("_pipeline_")]:
        raise ValueError(f"columns with names of the pipeline's own: {taken}")
    return docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    rules = quality.learn_rules(docs, load(spark, sf_dir, "labels"))
    stats = quality.text_statistics(_checked(docs), prefix=STATISTIC)
    kept = stats.where(~quality.base_failed(STATISTIC) & quality.verdict(rules, STATISTIC))
    return kept.select(*docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't take for toxic."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"), learn_from=~toxicity.held_out(F.col("doc_id")))
    return toxicity.score_texts(_checked(docs), model, into=SCORE).where(F.col(SCORE) < TOXIC).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one of the smallest doc_id, or of none if no row has one.

    Near copies share at least 0.8 of their five-word shingles (Jaccard): those that the trie
    join of fingerprints finds, and by an exact join those it can't find within its budget.
    """
    return simhash.deduplicate(docs, shingle=5, similarity=0.8, spare_unnamed=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, cut where it takes a part of one."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs, (1, 2, 3), cap=3.0, block_words=BLOCK_WORDS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Learned rules, a trained classifier and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage writes on its way goes once its result is written."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}"
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
