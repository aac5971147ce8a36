"""Sharding by extendible hashing.

The directory is indexed by bits of a key's hash. One bucket holds all rows at first; only
buckets over the byte limit split, on the next bit, until every bucket fits. Byte sums of
the directory's nodes are added up from its finest level, ``STEP`` bits below the expected
one, ``RISE`` levels at a time; rows whose bucket is still too large after these go into
another round with further bits. Key
bits are followed by bits of the text's hash, so a key that many rows share splits too; rows
alike in both split into overflow pages, by rank.

A lookup needs a key's hash and the directory alone: ``find`` a leaf whose prefix it has.

Defined cases: null keys hash as a key of their own; null and empty texts count 0 bytes; a
row over the limit gets a shard to itself; an empty table has an empty directory; repeated
rows are rows of their own. ``shard_rows`` looks at key and text only. ``write_shards`` writes
each row once, with all its columns: a row has the shard of its key and text, and of rows alike
in both, which may lie on several pages, each takes one of their places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, ranked, shared_dir

KEY_BITS, TEXT_BITS = 40, 20
BITS = KEY_BITS + TEXT_BITS
STEP, RISE = 8, 4


@dataclass
class Sharding:
    """rows: key, bits, text_hash, n_bytes, shard, depth, page, shard_bytes; directory: its leaves."""

    rows: DataFrame
    directory: DataFrame


def hash_bits(key: Column, text: Column) -> Column:
    """60 bits: 40 of the key's md5, then 20 of the text's."""
    hexes = F.concat(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, KEY_BITS // 4), F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, TEXT_BITS // 4))
    return F.conv(hexes, 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    """Null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _prefix(bits: Column, depth: Column | int) -> Column:
    """The first bits, as a number."""
    return F.call_function("shiftright", bits, F.lit(BITS) - depth)


def shard_rows(docs: DataFrame, limit: int, *, key: str = "doc_id", text: str = "text") -> Sharding:
    """Deal rows to shards of at most ``limit`` bytes of text."""
    if limit < 1:
        raise ValueError("limit must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    base = materialise(docs.select(F.col(key).alias("key"), text_hash(F.col(text)).alias("text_hash"), F.octet_length(body).cast("long").alias("n_bytes"), hash_bits(F.col(key), F.col(text)).alias("_bits")), "keys")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    start, open_, done, leaves = 0, base, [], []
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + STEP)
    while True:
        found = materialise(_leaves(open_, start, depth, limit), "leaves")
        leaves.append(found)
        least = found.agg(F.min("depth")).first()[0]  # above it, all rows would meet in a few nodes
        of = _fine_to_leaf(open_, found, start if least is None else least, depth)
        joined = open_.withColumn("_fine", _prefix(F.col("_bits"), F.lit(depth))).join(of, "_fine", "left").drop("_fine")
        joined = materialise(joined, "dealt")
        done.append(joined.where("depth is not null"))
        rest = joined.where("depth is null").select("key", "text_hash", "n_bytes", "_bits")
        if depth == BITS or rest.isEmpty():
            break
        open_, start, depth = rest, depth, min(BITS, depth + STEP)
    rows = done[0].withColumn("page", F.lit(0).cast("long"))
    for more in done[1:]:
        rows = rows.unionByName(more.withColumn("page", F.lit(0).cast("long")))
    directory = leaves[0]
    for more in leaves[1:]:
        directory = directory.unionByName(more)
    if depth == BITS and not rest.isEmpty():
        paged = _pages(rest, limit)
        rows = rows.unionByName(paged)
        directory = directory.unionByName(paged.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")))
    name = F.concat(F.lpad(F.bin("prefix"), F.col("depth"), "0"), F.when(F.col("page") > 0, F.concat(F.lit("."), F.col("page").cast("string"))).otherwise(""))
    rows = rows.select("key", F.col("_bits").alias("bits"), "text_hash", "n_bytes", F.when(F.col("depth") == 0, F.lit("")).otherwise(name).alias("shard"), F.col("depth").cast("int"), "page", "shard_bytes")
    return Sharding(rows, directory)


def _nodes(rows: DataFrame, start: int, depth: int) -> DataFrame:
    """Nodes of the directory below ``start`` bits: depth, prefix, shard_bytes, shard_rows.

    The finest are summed from the rows, and others from the lowest of ``RISE`` levels at a
    time, each a 2**RISE-th of the last: all levels cost little more than RISE times the finest.
    """
    folder, parts = shared_dir(rows.sparkSession), []
    fine = rows.groupBy(_prefix(F.col("_bits"), F.lit(depth)).alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    top, low = depth, max(start, depth - RISE + 1)
    while True:
        at = fine.select("prefix", "shard_bytes", "shard_rows", F.explode(F.sequence(F.lit(low), F.lit(min(depth, top)))).alias("depth"))
        up = F.call_function("shiftright", F.col("prefix"), F.lit(depth if not parts else top + 1) - F.col("depth"))
        level = at.groupBy("depth", up.alias("prefix")).agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_rows").alias("shard_rows"))
        parts.append(f"{folder}/nodes-{low}")
        level.write.parquet(parts[-1])
        read = rows.sparkSession.read.schema(level.schema)
        if low == start:
            return read.parquet(*parts)
        fine = read.parquet(parts[-1]).where(F.col("depth") == low).drop("depth")
        top, low = low - 1, max(start, low - RISE)


def _leaves(rows: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """Nodes that fit, or hold one row, and whose parent doesn't."""
    nodes = _nodes(rows, start, depth)
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1)
    large = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = nodes.where(fits & (F.col("depth") == 0)) if start == 0 else nodes.where("false")
    return nodes.where(fits).join(large, ["depth", "prefix"], "left_semi").unionByName(root)


def _fine_to_leaf(rows: DataFrame, leaves: DataFrame, least: int, depth: int) -> DataFrame:
    """The leaf of each finest prefix, by a sweep in order of prefixes below each of ``least`` bits, which no leaf spans."""
    fine = rows.select(_prefix(F.col("_bits"), F.lit(depth)).alias("_fine")).distinct()
    leaf = F.struct("depth", "prefix", "shard_bytes")
    starts = leaves.select(F.call_function("shiftleft", F.col("prefix"), F.lit(depth) - F.col("depth")).alias("_fine"), F.lit(0).alias("_kind"), leaf.alias("_leaf"))
    events = starts.unionByName(fine.select("_fine", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_leaf"].dataType).alias("_leaf")))
    sweep = W.partitionBy(F.call_function("shiftright", F.col("_fine"), F.lit(depth - least))).orderBy("_fine", "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = events.withColumn("_leaf", F.last("_leaf", True).over(sweep)).where("_kind = 1")
    inside = F.call_function("shiftright", F.col("_fine"), F.lit(depth) - F.col("_leaf.depth")) == F.col("_leaf.prefix")
    return found.where(inside).select("_fine", "_leaf.*")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for rows alike in key and text: such rows are interchangeable, so any rank does."""
    rows = ranked(rows, ["_bits"], "n_bytes")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("n_bytes"))))
    page = F.floor(F.col("_rank") / each)
    paged = materialise(rows.select("key", "text_hash", "n_bytes", "_bits", page.alias("page")), "pages")
    size = paged.groupBy("_bits", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(size, ["_bits", "page"]).select("key", "text_hash", "n_bytes", "_bits", F.lit(BITS).alias("depth"), F.col("_bits").alias("prefix"), "shard_bytes", "page")


#: Leaves of a directory that is sent to all executors, about 10 MB; beyond it rows are joined with their shards.
SMALL_DIRECTORY = 200_000


def write_shards(docs: DataFrame, sharding: Sharding, path: str, *, key: str = "doc_id", text: str = "text") -> None:
    """Write each row of documents once, a folder per shard; key and text as ``shard_rows`` had them.

    With a directory of at most ``SMALL_DIRECTORY`` leaves, rows look up their leaf where they
    are and texts are shuffled once; beyond it, they are joined with their shards first. The folders'
    column is ``shard``, with underscores after it if documents have a column of that name.
    """
    ids, bits = ["_bits", "_text"], F.col("_bits")
    places = sharding.rows.select(F.col("bits").alias("_bits"), F.col("text_hash").alias("_text"), "shard", "page")
    mine = docs.select(F.struct(*docs.columns).alias("_row"), hash_bits(F.col(key), F.col(text)).alias("_bits"), text_hash(F.col(text)).alias("_text"))
    paged = materialise(places.where("page > 0").select("_bits").distinct(), "paged")
    some_paged = not paged.isEmpty()
    single = mine.join(paged, "_bits", "left_anti") if some_paged else mine
    leaves = sharding.directory.select("depth", "prefix")
    if leaves.limit(SMALL_DIRECTORY + 1).count() <= SMALL_DIRECTORY:
        depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # at most BITS + 1
        name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), "0")).alias("shard")
        table = F.broadcast(leaves.select(F.col("depth").alias("_depth"), F.col("prefix").alias("_prefix"), name))
        each = single.select("*", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")).alias("_depth"))
        each = each.withColumn("_prefix", _prefix(bits, F.col("_depth")))
        out = each.join(table, ["_depth", "_prefix"]).select("_row", "shard")
    else:
        out = single.join(places.join(paged, "_bits", "left_anti").select(*ids, "shard").distinct(), ids).select("_row", "shard")
    if some_paged:
        counted = places.join(paged, "_bits", "left_semi").groupBy(*ids, "shard").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(W.partitionBy(*ids).orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
        counted = materialise(counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n")), "places")
        twins = ranked(materialise(mine.join(paged, "_bits", "left_semi"), "twins"), ids, "_text")
        out = out.unionByName(twins.join(counted, ids).where("_rank >= _from and _rank < _to").select("_row", "shard"))
    folder = shard_column(docs)
    out.select("_row.*", F.col("shard").alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


def shard_column(docs: DataFrame) -> str:
    name, taken = "shard", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The written documents with their shard, as the last column; docs: what has been written."""
    name = shard_column(docs)
    rows = docs.sparkSession.read.schema(docs.withColumn(name, F.lit("")).schema).parquet(path)
    return rows.withColumn(name, F.coalesce(name, F.lit("")))


def written_sizes(rows: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, shard, depth, page, shard_bytes of what has been read from shards."""
    rows = rows.select(F.col(key).alias("key"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(rows.columns[-1]).alias("shard"))
    size = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    page = F.coalesce(F.try_element_at(F.split("shard", "[.]"), F.lit(2)).cast("long"), F.lit(0))
    return rows.join(size, "shard").select("key", "n_bytes", "shard", F.length(F.substring_index("shard", ".", 1)).alias("depth"), page.alias("page"), "shard_bytes")
