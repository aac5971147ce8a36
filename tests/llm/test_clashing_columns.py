"""Extra columns whose names the operators use themselves, in any case: no crash, and the results without them."""

import pytest
from pyspark.sql import functions as F

from lattica.llm import minhash, mixing, packing, quality, resampling, sharding, simhash, spelling, token_store, toxicity, url_filter
from lattica.llm.common import shared_dir
from lattica.llm.tokens import tokenizer_path

NAMES = ["_best", "_url", "Shard", "shard_", "Score", "N_Words", "_row", "_KEY", "Node", "hashes", "_bits", "Host", "PATH", "rule", "Verdict", "Weight", "rank", "_rank", "source_", "size", "Tier", "word", "n", "Target"]
TEXTS = [None, "", "one two three four five six", "One two three four five six", "vile vile words here again and again", "considering considering considerin considerin " * 6]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "ab"[i % 2]) for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


def with_extra(df):
    return df.withColumns({n: F.concat(F.lit(n), F.coalesce(df[df.columns[0]].cast("string"), F.lit(""))) for n in NAMES})


MODEL = toxicity.Model({}, 0.0, 0.5)
OPERATORS = {
    "mix": lambda d: mixing.taken_words(mixing.mix_sources(d, (1, 2), cap=3.0)),
    "tokens": lambda d: token_store.crc_of_ids(token_store.read_tokens(token_store.lookup(d, s := token_store.write_tokens(d, f"{shared_dir(d.sparkSession)}/t", tokenizer_path("word_bpe_49k.json"), end_id=2)), s)),
    "scores": lambda d: toxicity.score_texts(d, MODEL).select("doc_id", "score"),
    "simhash": simhash.near_duplicates,
    "groups": simhash.similar_groups,
    "deduplicate": lambda d: simhash.deduplicate(d).select("doc_id", "text"),
    "statistics": lambda d: quality.text_statistics(d).select("doc_id", *quality.STATISTICS),
    "packing": lambda d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json"), end_id=1, with_ids=False).select("doc_id", "start", "length", "ids_crc32"),
    "shards": lambda d: _shards(d),
    "minhash": minhash.near_duplicates,
    "resampling": lambda d: resampling.resample(d, d.select(F.col("doc_id").alias("item_id"), "text"), least_words=3),
    "spelling": lambda d: spelling.variants(spelling.count_words(d)),
}


def _shards(d):
    path = f"{shared_dir(d.sparkSession)}/s"
    sharding.write_shards(d, sharding.shard_rows(d, 200), path)
    back = sharding.read_shards(d, path)
    assert back.columns[:-1] == d.columns and back.count() == d.count()
    return sharding.written_sizes(back)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_on_documents(docs, name):
    f = OPERATORS[name]
    plain, more = ([str(r) for r in f(d).collect()] for d in (docs, with_extra(docs)))
    if name in ("resampling", "mix"):  # repeated texts may change places among each other
        plain, more = (len(x) for x in (plain, more))
    else:
        plain, more = sorted(plain), sorted(more)
    assert plain == more


def test_urls(spark):
    urls = ["http://example.org/es/x", None, "http://a.com/de/", "http://example.org/es/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("block", "org", "/es"), ("allow", "com", "/")], "verdict string, host string, path string")
    own = ["page_id", "host", "path", "rule", "verdict"]
    got = url_filter.judge_urls(with_extra(pages), rules)
    assert sorted(map(str, got.select(*own).collect())) == sorted(map(str, url_filter.judge_urls(pages, rules).select(*own).collect()))
    kept = [c for c in NAMES if c.lower() not in own]
    assert [c for c in got.columns if c not in (*own, "url")] == kept
    assert all(r[c] == f"{c}{r['page_id']}" for r in got.collect() for c in kept)
    assert url_filter.judge_urls(pages.select(F.col("url").alias("Path")), rules, url="Path").count() == 4
