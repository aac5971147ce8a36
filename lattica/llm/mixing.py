"""Mixing sources to target weights (DataFrame functions only).

The words of each source are laid end to end, in an order that a hash of doc_id gives, and
cut into blocks of ``block_words``, or less where that would be over ``1 / FINEST`` of the
source or its target: so a source's quota, its target in whole blocks, is near its target
however small it is.

``counts`` is the draw: how many blocks of each source each output shard gets, as multinomial
draws conditioned on the quotas. The quotas' labels are dealt to the slots of all shards
through one pseudorandom permutation and counted, so a shard's counts are random, and those
of all shards add up to the quotas exactly. Slots are made from these counts: the j-th slot
of a source, in the order of shards, takes block ``pi(j mod n)``, where pi is the source's
own pseudorandom permutation of its n block numbers, another one in each pass over the
source. Slots and blocks then meet in an equi-join on (source, block), whose keys are
distinct on the block side however large a source is.

Defined cases: null or empty text has size 0 and is never drawn; a null source is a source
of its own, ordered last; repeated rows are documents of their own; a corpus without words
has targets 0 and no slices; columns other than doc_id, text and source are not looked at.
Reruns agree: every draw is a hash of (seed, source number, index).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, literal_table, materialise, ranked, word_count

#: The plan of sources is kept on the driver and broadcast; a corpus with more sources is refused.
MAX_SOURCES = 10_000
#: Slots that one row of the slot plan expands to, and shards whose counts are summed together.
SEGMENT, SHARDS = 4096, 1024
ROUNDS = 16
#: A block is at most this part of its source's size and target.
FINEST = 96


@dataclass
class Mix:
    """docs: doc_id, source, size, sid, start; sources: the plan; counts: the draw; slices: what the mix takes."""

    docs: DataFrame
    sources: list[dict]
    source_table: DataFrame
    counts: DataFrame
    slots: DataFrame
    slices: DataFrame


def permuted(index: Column, n: Column, *keys: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 by keys: the swap-or-not shuffle.

    Each round pairs x with (k - x) mod n and swaps the pair if a hash bit of its larger
    member says so; that is a bijection for every n, without cycle walking.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - x, n)
        bit = F.xxhash64(*keys, r, F.greatest(x, other), F.lit("bit")).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index.cast("long"), step)


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Share sum(sizes) by weight; what exceeds cap times a source's size goes to the others."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in set(open_))
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / share > cap * sizes[i]]
        for i in over or open_:
            out[i] = cap * sizes[i] if over else rest * weights[i] / share
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), *, cap: float = 3.0, block_words: int = 128, shard_slots: int = 1024, seed: int = 42) -> Mix:
    """Plan a mix. ``weights`` go to the sources by code point, repeating.

    ``slices`` has a row for each document that a drawn block touches: shard, slot, sid, turn
    (the pass over the source), block, doc_id, start (its row's place in the source),
    word_start, n_words.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_t"))
    base = materialise(base, "sizes")  # the only pass over texts
    stats = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in stats]
    by_weight = [weights[i % len(weights)] for i in range(len(stats))]
    wanted = targets(sizes, by_weight, cap)
    plan, dealt = [], 0
    for sid, (r, target) in enumerate(zip(stats, wanted)):
        words = max(1, min(block_words, int(min(r["size"], target) // FINEST)))
        n = math.ceil(r["size"] / words)
        quota = min(math.floor(cap * n), round(target * n / r["size"])) if n else 0
        plan.append({"sid": sid, "source": r["source"], "source_size": r["size"], "target": target, "words": words, "n_blocks": n, "quota": quota, "dealt": dealt})
        dealt += quota
    table = literal_table(spark, plan, "sid int, source string, source_size long, target double, words long, n_blocks long, quota long, dealt long")
    ids = F.broadcast(table.select("sid", F.col("source").alias("_src"), "words"))  # at most MAX_SOURCES rows

    rows = sum(r["rows"] for r in stats)
    per_chunk = max(64, math.isqrt(rows))
    chunks = max(1, math.ceil(rows / per_chunk))
    order = F.xxhash64(F.lit(seed), "doc_id", "_t")
    placed = base.join(ids, F.col("source").eqNullSafe(F.col("_src"))).drop("_src").withColumn("_h", order).withColumn("_chunk", F.pmod("_h", F.lit(chunks)))
    w = W.partitionBy("sid", "_chunk").orderBy("_h", "doc_id", "_t", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("_to", F.sum("size").over(w))
    before = placed.groupBy("sid", "_chunk").agg(F.sum("size").alias("_n"))
    before = before.withColumn("_base", F.sum("_n").over(W.partitionBy("sid").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    placed = placed.join(before, ["sid", "_chunk"]).select("doc_id", "source", "_t", "size", "sid", "words", (F.col("_base") + F.col("_to") - F.col("size")).alias("start"))

    words = F.col("words")
    first, last = F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words)
    pieces = placed.where("size > 0").select("doc_id", "sid", "start", "size", "words", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * words)
    pieces = pieces.select("sid", "block", "doc_id", "start", (lo - F.col("start")).alias("word_start"), (hi - lo).alias("n_words"))

    drawn = table.where("quota > 0")
    counts = materialise(_counts(drawn, dealt, shard_slots, seed), "counts")
    slots = _slots(counts, drawn, seed)
    # Slots come from a small plan, so their number would be underestimated and they would be
    # broadcast: both sides must be exchanged, as slots grow with the corpus.
    slices = slots.hint("merge").join(pieces, ["sid", "block"]).select("shard", "slot", "sid", "turn", "block", "doc_id", "start", "word_start", "n_words")
    return Mix(placed.drop("words"), plan, table, counts, slots, slices)


def _counts(table: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """The draw: blocks of each source in each output shard."""
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    segments = table.select("sid", "quota", "dealt", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / SEGMENT))).alias("seg"))
    segments = segments.repartition(parts, "sid", "seg")
    upto = F.least((F.col("seg") + 1) * SEGMENT, F.col("quota")) - 1
    labels = segments.select("sid", "dealt", F.explode(F.sequence(F.col("seg") * SEGMENT, upto)).alias("j"))
    place = permuted(F.col("dealt") + F.col("j"), F.lit(total), F.lit(seed), F.lit("deal"))
    return labels.groupBy(F.floor(place / shard_slots).alias("shard"), "sid").agg(F.count(F.lit(1)).alias("blocks"))


def _slots(counts: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """All slots that the counts ask for: shard, slot within it, sid, pass over the source, block."""
    # how many blocks of the source the shards before this one get, summed in chunks of shards
    counts = counts.withColumn("_chunk", F.floor(F.col("shard") / SHARDS))
    before = counts.groupBy("sid", "_chunk").agg(F.sum("blocks").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("sid").orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    before = before.select("sid", "_chunk", earlier.alias("_base"))
    within = F.sum("blocks").over(W.partitionBy("sid", "_chunk").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("blocks")
    placed = counts.withColumn("_in", within).join(before, ["sid", "_chunk"])
    # and where this source's slots begin in the shard, as many rows as a shard has sources
    of_shard = W.partitionBy("shard")
    begin = F.sum("blocks").over(of_shard.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) - F.col("blocks")
    placed = placed.select("shard", "sid", "blocks", (F.col("_base") + F.col("_in")).alias("_from"), begin.alias("_begin"), F.sum("blocks").over(of_shard).alias("_all"))
    blocks = F.broadcast(table.select("sid", "n_blocks"))  # at most MAX_SOURCES rows
    each = placed.join(blocks, "sid").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
    salt = F.lit(seed)
    each = each.withColumn("j", F.col("_from") + F.col("i"))
    turn = F.floor(F.col("j") / F.col("n_blocks"))
    block = permuted(F.pmod("j", "n_blocks"), F.col("n_blocks"), salt, F.col("sid"), turn)
    slot = permuted(F.col("_begin") + F.col("i"), F.col("_all"), salt, F.lit("slot"), F.col("shard"))
    return each.select("shard", slot.alias("slot"), "sid", turn.alias("turn"), block.alias("block"))


def taken_words(mix: Mix) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes."""
    key = ["doc_id", "sid", "start", "size"]
    drawn = mix.slices.groupBy("sid", "start").agg(F.sum("n_words").alias("n")).hint("merge")
    # (sid, start) names a row with words; rows without share theirs with others and are never drawn
    worded = mix.docs.where("size > 0").join(drawn, ["sid", "start"], "left").select(*key, F.coalesce("n", F.lit(0)).alias("taken"))
    every = worded.unionByName(mix.docs.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken")))
    plan = F.broadcast(mix.source_table.select("sid", "source_size", "target"))
    return every.join(plan, "sid").select("doc_id", F.col("size").cast("long"), "source_size", "target", F.col("taken").cast("long"))


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix as documents: a row for each run of words that a pass takes without a gap.

    A document that a pass takes completely is given back whole, with its own text; of others
    the row has the run's words and the blanks before them. Rows of ``docs`` meet their runs by
    (doc_id, source, text hash), rows alike in these by rank.
    """
    words_of = W.partitionBy("sid", "start").orderBy("turn", "word_start")
    follows = (F.lag("turn").over(words_of) == F.col("turn")) & (F.lag(F.col("word_start") + F.col("n_words")).over(words_of) == F.col("word_start"))
    begins = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    runs = mix.slices.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(words_of.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("sid", "start", "_run").agg(F.min("word_start").alias("word_start"), F.sum("n_words").alias("n_words"))
    spans = runs.groupBy("sid", "start").agg(F.collect_list(F.struct("word_start", "n_words")).alias("_spans"))  # as many as a document's blocks

    ids, keys, other = (["_id", "_s", "_t"], [f"_k{i}" for i in range(3)], [f"_o{i}" for i in range(3)])
    alike = lambda a, b: F.col(a[0]).eqNullSafe(F.col(b[0])) & F.col(a[1]).eqNullSafe(F.col(b[1])) & (F.col(a[2]) == F.col(b[2]))
    mine = mix.docs.where("size > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), "_t", F.col("size").alias("_size"), "sid", F.col("start").alias("_at"))
    mine = materialise(mine.join(spans.withColumnRenamed("start", "_at"), ["sid", "_at"], "left"), "spans")
    several = materialise(mine.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "twins")
    twins = several.select(*(F.col(k).alias(o) for k, o in zip(ids, other)))
    # the rows as they are, in a struct, so that no column's name can clash
    theirs = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_k0"), F.col("source").cast("string").alias("_k1"), F.xxhash64("text").alias("_k2"))
    columns = ["_row", "_size", "_spans"]
    out = theirs.join(mine.join(twins, alike(ids, other), "left_anti"), alike(keys, ids)).select(*columns)
    if not several.isEmpty():  # repeated rows: any of them may take the runs of any other
        theirs2 = ranked(materialise(theirs.join(twins, alike(keys, other), "left_semi"), "theirs"), keys, "_k2")
        mine2 = ranked(materialise(mine.join(twins, alike(ids, other), "left_semi"), "mine"), ids, "_at").withColumnRenamed("_rank", "_rank2")
        out = out.unionByName(theirs2.join(mine2, alike(keys, ids) & (F.col("_rank") == F.col("_rank2"))).select(*columns))
    out = out.where("_spans is not null").withColumn("_text", F.col("_row.text"))

    words = F.regexp_extract_all(F.col("_text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    whole = lambda s: s["n_words"] == F.col("_size")
    span = lambda w: lambda s: F.when(whole(s), F.col("_text")).otherwise(F.array_join(F.slice(w, (s["word_start"] + 1).cast("int"), s["n_words"].cast("int")), ""))
    # the words as a lambda's variable: a column would be split anew for each run; whole documents aren't split
    split = F.when(F.exists("_spans", lambda s: ~whole(s)), words).otherwise(F.array().cast("array<string>"))
    cut = F.flatten(F.transform(F.array(split), lambda w: F.transform("_spans", span(w))))
    out = out.select("_row", F.explode(cut).alias("_cut"))
    changed = {"text": F.col("_cut"), "n_chars": F.length("_cut").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in docs.columns))
