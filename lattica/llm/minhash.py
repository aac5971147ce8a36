"""Circulant MinHash near-dedup.

Two permutations of the 64-bit hashes give all coordinates of a signature: the first scatters a
text's shingles, the second is shifted circularly by one more for each coordinate, and the
coordinate is the least of the shifted images. A band is a run of ``rows`` coordinates, and
texts that agree in a band meet in its bucket. Two sets of similarity s share one of ``bands``
buckets but with a chance of (1 - s**rows)**bands: 1.4e-7 at 0.8 with 30 bands of 4, less above.

Distinct shingle sets are the nodes, so what copies share is hashed and bucketed once. Sets are
made again for the texts that share a bucket, a part of all, so that the others' never move. What
buckets bring together is verified on whole sets, in two steps. In buckets of more than
``CROWD`` nodes each node is first compared with the head of the most crowded bucket that it is
in, one pair for each node, which makes one component of most of a large group of near copies. Then buckets
that still hold several components connect their nodes to groups, and a group's sets meet in one
task, which compares those that can be similar by size and shared shingles and aren't connected
yet; groups of too many shingles are split into chunks (``simhash.similar_links``). So all pairs
of a bucket are covered, but never listed. Components come from star contraction.

Defined cases: a text of fewer words than a shingle is one shingle; without words or text the
set is empty and linked with nothing, so the component is the row's own doc_id; repeated rows
and null doc_ids are rows of their own, and a component of null doc_ids only has a null id and
keeps nothing; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .simhash import components, shingle_table, similar_links, similar_pairs, with_hash

BANDS, ROWS = 30, 4
#: Nodes of a bucket before its head is compared first.
CROWD = 64
#: Images that are computed at a time: they fit a processor's cache.
IMAGES = 1 << 16
_U = np.uint64
#: Odd factors and a mask: the two permutations are multiplications, shifts and sums modulo 2**64, all one to one.
_FIRST, _SECOND, _THIRD, _BAND = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def scattered(hashes: np.ndarray) -> np.ndarray:
    """The first permutation."""
    x = (hashes ^ (hashes >> _U(31))) * _FIRST
    return x ^ (x >> _U(29))


def permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation."""
    x = x * _SECOND
    x = (x ^ (x >> _U(32))) * _THIRD
    return x ^ (x >> _U(32))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: coordinate k is the least image of the scattered hashes, each moved on by k."""
    least = np.full(size, ~_U(0))
    steps = np.arange(size, dtype=_U)[:, None] * _SECOND  # (x + k) * factor is x * factor + k * factor
    width = max(1, IMAGES // size)
    for at in range(0, len(hashes), width):
        y = scattered(hashes[at : at + width]) * _SECOND + steps
        z = y >> _U(32)
        y ^= z
        y *= _THIRD
        np.right_shift(y, _U(32), out=z)
        y ^= z
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for each band, of its number and coordinates."""
    key = np.arange(bands, dtype=_U)
    for column in signature(hashes, bands * rows).reshape(bands, rows).T:
        key = (key ^ column) * _BAND
        key ^= key >> _U(32)
    return key.view(np.int64).tolist()


def near_duplicates(docs: DataFrame, *, shingle: int = 4, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id is that)."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    table = materialise(shingle_table(docs, shingle, lambda found: band_keys(found, bands, rows)).drop("print", "hashes"), "nodes")
    entries = table.where("signs is not null").select("node", F.explode("signs").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("other")).where("head <> other")
    met = materialise(entries.join(materialise(buckets.select("key", "head"), "buckets"), "key"), "met")
    named = table.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("first"))
    wanted = materialise(named.join(met.select("node").distinct(), "node", "left_semi").select("text_hash"), "wanted")
    # joined by exchange at any size: a frequent text can be split then, and texts move once at most
    texts = with_hash(docs).join(wanted.hint("merge"), "text_hash", "left_semi")
    sets = materialise(shingle_table(texts, shingle).where("hashes is not null").select("node", F.col("n").cast("int").alias("n"), "hashes"), "sets")

    crowds = materialise(met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD), "crowds")
    crowded = met.join(crowds, "key").where("node <> head")
    first = crowded.groupBy("node").agg(F.max(F.struct("m", "head")).alias("top")).select("node", F.col("top.head").alias("head"))
    pairs = materialise(first.select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")).distinct(), "pairs")
    known = components(similar_pairs(pairs, sets, similarity))

    placed = met.select("key", "node", "head").join(known.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    placed = materialise(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    apart = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    edges = placed.join(materialise(apart, "apart"), "key").where("node <> head")
    groups = components(edges.select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")))
    links = known.unionByName(similar_links(sets, groups, known, similarity))

    found = _least(named.select("node", "first"), components(links))
    # what is joined on is written, so that copies of one text can be split
    joined = table.select("doc_id", "node", "n").join(found, "node", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _least(named: DataFrame, stars: DataFrame) -> DataFrame:
    """node and least, the smallest doc_id of its component."""
    rooted = materialise(named.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    return materialise(rooted.join(least, "root").select("node", "least"), "found")
