"""What is dear in the audit queries is done once for a row, however many columns and filters use it."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import parse, text
from lattica.operators import metrics, mining
from lattica.plans import audit, queries

SF = "/root/testdata/sf0.001"


def matches(df):
    """How often the plan matches the grammar of answers."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(parse._grammar()[:20])


def test_bad_cases_parse_once(spark):
    assert matches(metrics.bad_cases(queries.scored(spark, SF))) == 1


def test_error_tag_histogram_parses_once(spark):
    assert matches(metrics.tag_counts(queries.scored(spark, SF))) == 1


def test_preference_pairs_parse_once(spark):
    assert matches(mining.mark_errors(audit.aligned(spark, SF)).where(F.size("error_tags") > 0)) == 1


def test_tokenizer_pieces_count_a_word_once(spark, monkeypatch):
    """The library sees each word once, and gives what it gives for whole texts."""
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    real, asked = tokenizers.Tokenizer.from_file(path), []

    class Counting:
        truncation = padding = None
        model = real.model

        @staticmethod
        def from_file(_):
            return Counting()

        def encode(self, words, **settings):
            asked.extend(words)
            return real.encode(words, **settings)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    numbers, texts = metrics.word_numbers(path), ["Unbelievable w1 don't w1", "w1 x.y,z... unbelievable 12345 日本語", "", "  é W1 don't Unbelievable"]
    for text in texts:
        want = [w for w in real.encode(text.split(), is_pretokenized=True, add_special_tokens=False).word_ids if w is not None] if text.split() else []
        assert numbers(text) == want
    assert len(asked) == len(set(asked)) > 5


@pytest.mark.parametrize("length", [3, 6, 40])
def test_subwords_by_words(spark, length):
    """Cells from sub-words of each word are those from sets of sub-words; positions repeat and lie beyond the words."""
    rows = [(i, " ".join("w" * (k % 5 + 1) for k in range(n)), [0, 2, 2, n, -1], [2, 3, 3, 70][: i + 1]) for i, n in enumerate((0, 1, 5, 12))]
    df = spark.createDataFrame([(i, c, (t,), (p,)) for i, c, t, p in rows], "id int, caption string, target struct<text_positions:array<int>>, parsed struct<text_positions:array<int>>")
    pieces = lambda text: [i for i, w in enumerate(text.split()) for _ in w]
    got = [tuple(r) for r in metrics.subword_counts(df, pieces, max_length=length).select("tp", "tn", "fp", "fn").collect()]
    want = []
    for _, c, t, p in rows:
        w = pieces(c)[: length - 2]
        a, b = ({k for k, x in enumerate(w) if x in xs} for xs in (t, p))
        want.append((len(a & b), len(w) - len(a | b), len(b - a), len(a - b)))
    assert sorted(got) == sorted(want)


def test_types_of_average_precision_parse_once(spark):
    assert matches(queries.typed(spark, SF)) == 1


#: Queries whose plan is lazy as a whole.
LAZY = ["score_vectors", "reward_summary", "generated_confusion", "grounding_summary", "set_f1", "type_score_lists", "binary_confusion", "bbox_iou"]


@pytest.mark.parametrize("name", LAZY)
def test_queries_parse_once(spark, name):
    assert matches(queries.QUERIES[name](spark, SF)) == 1


def test_scores_of_eer_parse_once_and_meet_by_number(spark):
    plan = queries.scored(spark, SF).select("label", "score")
    assert matches(plan) == 1
    assert "cast(id" not in plan._jdf.queryExecution().optimizedPlan().toString()  # the join of whole numbers doesn't make texts of them


def count(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_rewards_compare_sets_once(spark):
    """One comparison of types, one of positions, and the parser's own."""
    assert count(queries._rewarded(spark, SF), "array_intersect") == 3


def test_captions_are_split_once(spark):
    """Once where they are plain and once where they aren't, not for each position."""
    assert count(queries.QUERIES["grounding_summary"](spark, SF), "split(caption") == 2


def test_words_of_any_blanks(spark):
    texts = ["", " ", "a", " a  b ", "a\tb\n", "\u3000a\u00a0b", "é è", "a\x1cb", "a\x7fb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string").select("i", text.count_words(F.col("t")).alias("n"))
    assert {r["i"]: r["n"] for r in df.collect()} == {i: len(t.split()) for i, t in enumerate(texts)} | {99: None}


def test_type_scores_are_read_once_each_way(spark):
    assert count(queries.QUERIES["type_score_lists"](spark, SF), "get_json_object") == 2


def test_overlap_is_computed_once(spark):
    assert count(queries.QUERIES["bbox_iou"](spark, SF), "greatest") <= 11  # 23 with the overlap in two places
