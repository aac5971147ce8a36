"""Audit records derived from the order tables, for queries and benchmarks.

An order k of customer c is one annotated sample with one model response. Four bits of k are
its manipulation types; the response has other types for every fifth customer, a shifted box
for most orders, and for some orders isn't JSON, is fenced, has prose around it, has other
names for its fields and types, corners out of order or a position that is too large.

Records are made once for a session and a state of the order table's files, spread over tasks,
and written; queries read them like tables (``truth``, ``responses``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.labels import build_target, canonical_answer, strings
from ..functions.parse import parse_response
from ..storage import materialise
from ..types import TYPE_ORDER

SIZE = 1000
_MADE: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of each file of a table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, files = [], target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def once(spark: SparkSession, sf_dir: str, name: str, make, source: str = "orders") -> DataFrame:
    """What ``make`` gives, written at the first call of a session and again whenever the source's files have changed."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _files(spark, f"{sf_dir}/{source}.parquet")
    if key not in _MADE or _MADE[key][0] != state:
        _MADE[key] = state, materialise(make(spark, sf_dir), name)
    return _MADE[key][1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and c of each order, dealt to as many tasks as a shuffle has: a file may be one split."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).repartition(tasks)


def label_of(bits: Column) -> Column:
    named = F.filter(F.array(*[F.when(bits.bitwiseAND(1 << i) > 0, F.lit(t)) for i, t in enumerate(TYPE_ORDER)]), lambda x: x.isNotNull())
    return F.when(bits == 0, "orig").otherwise(F.array_join(named, "&"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, c, label, box, positions, and those of the response."""
    k, c = F.col("k"), F.col("c")
    shift, x, y = (k % 4) * (c % 30), c % 500, (k * 7) % 500
    corners = (x, y, x + 1 + (c % 7) * 50, y + 1 + (k % 50) * 8)
    return keys(spark, sf_dir).select(
        "k", "c", label_of(k % 16).alias("label"), F.array(*corners).alias("box"), F.array(k % 50, c % 50, (k + c) % 7).alias("positions"),
        label_of(F.when(c % 5 == 0, (k + 3) % 16).otherwise(k % 16)).alias("said_label"), F.array(*[v + shift for v in corners]).alias("said_box"), F.array(k % 50, (c + k % 3) % 50, (k + c) % 7).alias("said_positions"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, c, label, caption and target."""
    return once(spark, sf_dir, "truth", _truth)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, response, manipulated_score and type_scores."""
    return once(spark, sf_dir, "responses", _responses)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.lit(SIZE)
    target = build_target(F.col("label"), F.col("box"), F.col("positions"), size, size)
    return annotations(spark, sf_dir).select(F.col("k").alias("id"), F.col("k").alias("ord"), "c", "label", caption(F.col("k")).alias("caption"), target.alias("target"))


def caption(k: Column) -> Column:
    """10 to 49 words."""
    return F.array_join(F.transform(F.sequence(F.lit(1), (10 + k % 40).cast("int")), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k, c = F.lit(SIZE), F.col("k"), F.col("c")
    listed = lambda xs: F.concat(F.lit("["), F.array_join(xs.cast("array<string>"), ","), F.lit("]"))

    def renamed(said: Column) -> Column:
        return F.concat(
            F.lit('{"label":"'), F.when(said["verdict"] == "pristine", "real").otherwise("fake"), F.lit('","badcase_types":"'), F.array_join(said["types"], ","),
            F.lit('","evidence_bbox":'), F.coalesce(listed(said["image_bbox"]), F.lit("null")), F.lit(',"evidence_text_pos":'), listed(said["text_positions"]), F.lit("}"),
        )

    def written(said: Column) -> Column:
        before = F.when(k % 11 == 0, "```json\n").when(k % 13 == 0, "The answer is ").otherwise("")
        after = F.when(k % 11 == 0, "\n```").when(k % 13 == 0, " as asked.").otherwise("")
        return F.when((k % 17 == 0) & (before == ""), renamed(said)).otherwise(F.concat(before, canonical_answer(said), after))

    odd = (
        F.when(k % 7 == 0, "not json").when((k % 11 == 0) | (k % 13 == 0) | (k % 17 == 0), F.lit(None))
        .when(k % 19 == 0, '{"verdict":"fake","types":["fs"],"image_bbox":[9,9,1,1]}').when(k % 23 == 0, '{"verdict":"fake","types":["ts"],"text_positions":[50]}')
    )
    text = F.coalesce(odd, bind(build_target(F.col("said_label"), F.col("said_box"), F.col("said_positions"), size, size), written))
    scores = F.map_from_arrays(strings(TYPE_ORDER), F.array(*[((k * (i + 2) + c) % 10007) / 10007.0 for i in range(4)]))
    return annotations(spark, sf_dir).select(k.alias("id"), k.alias("ord"), text.alias("response"), (((k * 7919 + c * 31) % 65521) / 65521.0).alias("manipulated_score"), scores.alias("type_scores"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and parsed response of each sample."""
    from ..operators.align import align

    both = align(truth(spark, sf_dir), responses(spark, sf_dir))
    return both.withColumn("parsed", parse_response(F.col("response"))).drop("pred_id", "pred_ord")
