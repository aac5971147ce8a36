"""SimHash near-dedup with a binary trie self-join.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's
word shingles. Distinct fingerprints link if they differ in at most ``budget`` bits; what
many copies share is one fingerprint, and only meets others once.

Two fingerprints within the budget agree in one of budget + 1 blocks of bits. So there are
budget + 1 tries, each over the fingerprints turned left until a block is at the top, and the
subtrees below a block's values are joined apart from each other: each with itself, by
traversing pairs of nodes together, adding up the bits in which their paths differ and
dropping a pair whose sum exceeds the budget. Pairs whose leaves are all in one component
already are dropped too, so a large group of near copies costs links, not pairs; a task
returns a spanning forest. A block value that many fingerprints share is split by a hash into
chunks of ``HOT_ROWS``, and each pair of chunks is a task that joins their two tries.

``similar_groups`` groups by a similarity of shingle sets, 0.8 unless told otherwise. Distinct
sets are its nodes. The trie join of their fingerprints comes first: it finds copies with small
edits, whose sets are then compared, so that only true links stay. But at a similarity of 0.8
two texts differ in 10 bits of 64, where a budget that keeps the tries small finds few. So an
exact join finds the rest: shingles are ordered by how many nodes have them, those of one node
alone first. If a shingle is at place p of n of a node, and none before it is shared, at most
n - p are; so it can only be the first shared one with a node of at most
(n - p) (1 + t) / t - n shingles, t being the similarity. Of two similar nodes the smaller one
has its first shared shingle at a place that leaves room for a node of its own size. A shingle
connects what may be similar by these bounds and by sizes (``candidates``, counts and joins of
Spark that a frequent shingle can't unbalance); pages of one template that have too much of
their own get no candidate at all. What is connected meets in a task, which orders shingles by
how many of the task's nodes have them, looks up partners by the same bounds, and compares whole
sets, those of the commonest shingles with all others first, but no pairs that links connect
already. So a large group around one text costs links, not pairs, and no pair that isn't similar
ever stands in for one that is. Groups of more than ``TASK_ENTRIES`` shingles are split into
chunks by a hash: each chunk is a task, and each pair of chunks is one that compares across. Texts
that are a little under the similarity to each other, by edits to one base that is missing, still
cost pairs. The result is exact but for collisions of 64-bit hashes, of shingles and of sets.

Shingles are counted in packed rows, dealt to parts of up to about ``TASK_ENTRIES`` by their hashes.
A part that a frequent shingle makes too large is dealt again by node: its chunks are counted
apart, the counts are summed and come back to each chunk. Whole sets are never written: texts are
read twice, first for the nodes and how many shingles fall into each of ``CELLS`` ranges of hashes,
then for the sets, which are packed in the task that makes them.

Components of all forests come from star contraction in rounds, each written to the shared
folder, with every side of a join, so that the links of one large group's centre can be split.
No links, fingerprints or frequent values are gathered on the driver.

Defined cases: null and empty texts have fingerprint 0 and link like any other; texts of
fewer words than a shingle are one shingle; repeated rows and null doc_ids are rows of their
own, and a component of null doc_ids only has a null id; an empty table gives an empty one.
Other columns are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete_folder, materialise, scratch, shuffles_removed, unscratched, written

SEED = 42
#: Rows of a task, and of a block value before it is split.
TASK_ROWS, HOT_ROWS = 40_000, 20_000
#: Node pairs with at most so many leaf pairs are compared leaf by leaf; pairs taken at a time.
LEAF_PAIRS, FRONTIER = 1024, 50_000
#: Shingles of a task that counts or compares sets, and of a Python worker's buffer.
TASK_ENTRIES, BUFFER = 1 << 20, 1 << 19
#: Share of these that a task compares.
COMPARED = 0.5
#: Ranges of hashes whose shingles are counted when texts are read first; a power of two.
CELLS = 1 << 16
#: Shingles whose bits are counted at a time.
SLICE = 1 << 16
#: Nodes that a task remembers to have given.
GIVEN = 1 << 20


def fingerprint(text: bytes, shingle: int = 4) -> int:
    joined, starts, stops = _windows(text, shingle)
    n = len(starts)
    if not n:
        return 0
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + SLICE], stops[at : at + SLICE])], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Components of 0..n-1."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.edges: list[tuple[int, int]] = []  # the pairs that joined two components

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        apart = self.of[a] != self.of[b]
        if not apart.any():
            return False
        pairs, at = np.unique(np.stack([self.of[a[apart]], self.of[b[apart]]], axis=1), axis=0, return_index=True)
        a, b = a[apart][at].tolist(), b[apart][at].tolist()
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for (x, y), i, j in zip(pairs.tolist(), a, b):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.edges.append((i, j))
        heads = np.array(list(up), np.int64)
        self.of[heads] = [root(x) for x in heads.tolist()]
        self.of = self.of[self.of]
        return True


def trie_join(a: np.ndarray, b: np.ndarray | None, fixed: int, budget: int, forest: Forest) -> None:
    """Link in ``forest`` what differs in at most ``budget`` bits and agrees in the first ``fixed``.

    a and b are sorted distinct 64-bit numbers, each a trie whose nodes are ranges; without b,
    a is joined with itself. b's numbers come after a's in the forest.
    """
    same, b = b is None, a if b is None else b
    shift = 0 if same else len(a)
    top = np.uint64(64 - fixed)
    pa_, a_lo = np.unique(a >> top, return_index=True)
    pb_, b_lo = np.unique(b >> top, return_index=True)
    a_hi, b_hi = np.append(a_lo[1:], len(a)), np.append(b_lo[1:], len(b))
    _, i, j = np.intersect1d(pa_, pb_, assume_unique=True, return_indices=True)
    stack = [(fixed, np.stack([a_lo[i], a_hi[i], b_lo[j], b_hi[j], np.zeros(len(i), np.int64)]))]
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > FRONTIER:
            stack += [(depth, nodes[:, k : k + FRONTIER]) for k in range(0, nodes.shape[1], FRONTIER)][::-1]
            continue
        of_a, of_b = forest.of[: len(a)], forest.of[shift : shift + len(b)]
        turns_a, turns_b = (np.append(0, np.cumsum(x[1:] != x[:-1])) for x in (of_a, of_b))
        alo, ahi, blo, bhi, err = nodes
        settled = (turns_a[alo] == turns_a[ahi - 1]) & (turns_b[blo] == turns_b[bhi - 1]) & (of_a[alo] == of_b[blo])
        nodes = nodes[:, ~settled]
        leaf = ((nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= LEAF_PAIRS) | (depth >= 64)
        _leaves(a, b, nodes[:, leaf], budget, forest, shift)
        alo, ahi, blo, bhi, err = nodes = nodes[:, ~leaf]
        if not nodes.shape[1]:
            continue
        low = np.uint64(63 - depth)

        def middle(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(v, ((v[lo] >> low) | np.uint64(1)) << low), lo, hi)

        am, bm = middle(a, alo, ahi), middle(b, blo, bhi)
        itself = same & (alo == blo) & (ahi == bhi)
        across = np.stack([np.append(alo, am[~itself]), np.append(am, ahi[~itself]), np.append(bm, blo[~itself]), np.append(bhi, bm[~itself]), np.append(err, err[~itself]) + 1])
        along = np.stack([np.append(alo, am), np.append(am, ahi), np.append(blo, bm), np.append(bm, bhi), np.append(err, err)])
        for pairs in (across[:, across[4] <= budget], along):  # pairs along one path come off the stack first
            pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3])]
            if pairs.shape[1]:
                stack.append((depth + 1, pairs))


def _leaves(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, budget: int, forest: Forest, shift: int) -> None:
    n = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
    cuts = np.searchsorted(np.cumsum(n), np.arange(1 << 20, n.sum() + (1 << 20), 1 << 20), "right") if len(n) else []
    for part in np.split(np.arange(len(n)), np.unique(cuts)):
        if not len(part):
            continue
        alo, _, blo, bhi, _ = nodes[:, part]
        size, width = n[part], (bhi - blo)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        w = np.repeat(width, size)
        i, j = np.repeat(alo, size) + k // w, np.repeat(blo, size) + k % w
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        forest.link(i[near], j[near] + shift)


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks, from the top."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by % 64 else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _block_value(fp: Column, lo: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(fp, lo), 64 - bits)


def _tasks(rows: DataFrame, total: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """Deal (node, print, fp) to tasks: node, fp, print, block, task, side. Each pair of fp that agree in a block meets in one."""
    by_block = F.array(*[F.struct(F.lit(i).alias("block"), _block_value(F.col("fp"), lo, n).alias("value")) for i, (lo, n) in enumerate(blocks)])
    key = ["print", "block", "value"]
    rows = rows.select("node", "print", "fp", F.inline(by_block))
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    hot = materialise(counts.select(*key, (F.ceil(F.col("n") / HOT_ROWS) + 1).cast("int").alias("chunks")), "hot")  # written, so Spark knows its size
    rows = rows.join(hot, key, "left")
    bins = max(1, math.ceil(total * len(blocks) / TASK_ROWS))
    bin_ = F.pmod(F.xxhash64(*key), F.lit(bins))
    cold = rows.where("chunks is null").select("node", "fp", "print", "block", F.concat_ws(":", F.lit("c"), "print", "block", bin_).alias("task"), F.lit(0).alias("side"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    split = rows.where("chunks is not null").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = (F.least("mine", "other"), F.greatest("mine", "other"))
    split = split.select("node", "fp", "print", "block", F.concat_ws(":", F.lit("h"), *key, *pair).alias("task"), F.when(F.col("mine") == pair[0], 0).otherwise(1).alias("side"))
    return cold.unionByName(split)


def links(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """Edges (u, v), u > v, that connect all of fp that differ in at most ``budget`` bits, and no others."""
    blocks = _blocks(budget)
    rows = distinct.select(F.col("fp").alias("node"), F.lit(0).alias("print"), "fp")
    return _tasks(rows, distinct.count(), blocks).groupBy("task").applyInPandas(lambda t: _join_task(t, blocks, (budget,)), "u long, v long")


def _join_task(rows: pd.DataFrame, blocks: list[tuple[int, int]], budgets: tuple[int, ...]) -> pd.DataFrame:
    """Links of a task's nodes, those within the smaller budgets first."""
    by, fixed = blocks[int(rows["block"].iloc[0])]
    sides, nodes, found = [], [], []
    for s in (0, 1):
        side = rows[rows["side"] == s]
        fp, node = _turned(side["fp"].to_numpy(np.int64).view(np.uint64), by), side["node"].to_numpy(np.int64)
        order = np.lexsort((node, fp))
        fp, node = fp[order], node[order]
        first = np.append(True, fp[1:] != fp[:-1])[: len(fp)]
        head = node[first]
        found.append(np.stack([node[~first], head[np.cumsum(first) - 1][~first]], axis=1))  # nodes of one fingerprint
        sides.append(fp[first])
        nodes.append(head)
    a, b = sides[0], sides[1] if len(sides[1]) else None
    forest = Forest(len(a) + len(sides[1]))
    for budget in budgets:
        trie_join(a, b, fixed, budget, forest)
    of = np.concatenate(nodes)
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    edges = np.concatenate([*found, of[edges]])
    edges = edges[edges[:, 0] != edges[:, 1]]
    return pd.DataFrame({"u": edges.max(axis=1, initial=-(2**63)), "v": edges.min(axis=1, initial=2**63 - 1)})


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the least of its component, and that least node. Edges have u > v.

    What is joined on is written first: two plain exchanges, of which a hot side can be split.
    """
    spark = edges.sparkSession
    edges, folder = written(edges.distinct(), "edges")
    sign = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = sign(edges)
    while before[0]:
        with scratch(spark):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            large = materialise(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            stars, new = _outside(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        delete_folder(spark, folder)
        edges, folder = stars, new
        after = sign(edges)
        if after == before:
            break
        before = after
    return edges


def _outside(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` for what outlives the innermost ``scratch``."""
    with unscratched():
        return written(df, name)


def near_duplicates(docs: DataFrame, *, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    base = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = base.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return _with_least(base, distinct, components(links(distinct.select("fp"), budget)))


def _with_least(base: DataFrame, distinct: DataFrame, stars: DataFrame) -> DataFrame:
    """Rows of (doc_id, fp) with the smallest doc_id of their component; distinct: fp and its smallest doc_id."""
    return base.join(_least(distinct, stars), "fp").select("doc_id", "fp", "component_id")


def _least(distinct: DataFrame, stars: DataFrame) -> DataFrame:
    """fp and component_id, the least ``first`` of its component."""
    members = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    members = materialise(members.join(distinct, "fp"), "members")
    least = materialise(members.groupBy("root").agg(F.min("first").alias("least")), "least")
    linked = members.join(least, "root").select("fp", "least")
    # written, so that both sides of the last join are plain exchanges, whose hot keys can be split
    return materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _windows(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words with single spaces between them, and where each shingle starts and stops."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    return b" ".join(words), np.append(0, ends[:-1] + 1)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    joined, starts, stops = _windows(text, shingle)
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _set_id(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_print(found: np.ndarray) -> int:
    """The fingerprint of a shingle set, as a signed number: bits set in over half of its hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), SLICE):
        counts += np.unpackbits(found[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big", signed=True)


SHINGLED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("hashes", pa.binary()), ("signs", pa.list_(pa.int64()))])


def _shingled(batches: Iterator[pa.RecordBatch], shingle: int, sign: Callable[[np.ndarray], list[int]] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``shingle_table``, in batches of about ``BUFFER`` shingles."""
    rows, held, given = [], 0, set()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SHINGLED)], schema=SHINGLED)

    for b in batches:
        for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text")):
            found = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle)
            node = _set_id(found)
            new = len(found) and node not in given
            if len(given) > GIVEN:
                given.clear()
            given.add(node)
            rows.append((i, h, node, len(found), set_print(found), found.tobytes() if new and not sign else None, sign(found) if new and sign else None))
            held += len(found)
            if held >= BUFFER:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()
            rows, held = [], 0


def shingle_table(docs: DataFrame, shingle: int = 5, sign: Callable[[np.ndarray], list[int]] | None = None) -> DataFrame:
    """Per row doc_id, text_hash, node, which names its shingle set, the set's size n and its fingerprint.

    ``hashes``, the set, or if ``sign`` is given ``signs``, what it makes of the set, are null in rows
    whose node the task has given before, so that copies don't carry sets of their own.
    """
    schema = "doc_id long, text_hash long, node long, n long, print long, hashes binary, signs array<long>"
    return with_hash(docs).mapInArrow(lambda batches: _shingled(batches, shingle, sign), schema)


def node_table(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``shingle_table`` without the sets.

    In one row of a batch, ``entries`` is the number of shingles of the sets that the batch would
    give, and ``cells`` how many of them are in each of ``CELLS`` ranges of hashes; else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shingled(batches, shingle):
            hashes = np.frombuffer(b"".join(b.column("hashes").drop_null().to_pylist()), np.uint64)
            cells = zlib.compress(np.bincount(_part(hashes, CELLS), minlength=CELLS).astype(np.uint32).tobytes(), 1)
            once = lambda x, kind: pa.array([x] + [None] * (b.num_rows - 1), kind)
            arrays = [*(b.column(c) for c in ("doc_id", "text_hash", "node", "print")), once(len(hashes), pa.int64()), once(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "node", "print", "entries", "cells"])

    return with_hash(docs).mapInArrow(run, "doc_id long, text_hash long, node long, print long, entries long, cells binary")


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


#: Shingles of many nodes in a row: the nodes, their sets' sizes, how many shingles each has here, and these. Small numbers are compressed.
DEFLATED = ("sizes", "counts", "ranks")
PACK = {"nodes": np.int64, "sizes": np.int32, "counts": np.int32, "hashes": np.uint64, "ranks": np.uint8}


def _pack(part: np.ndarray, node: np.ndarray, size: np.ndarray, hashes: np.ndarray, ranks: np.ndarray) -> pd.DataFrame:
    """A row for each part."""
    order = np.lexsort((node, part))
    part, node, size, hashes, ranks = (x[order] for x in (part, node, size, hashes, ranks))
    runs = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (node[1:] != node[:-1]))[: len(part)])
    counts = np.diff(np.append(runs, len(part))).astype(np.int32)
    first = np.flatnonzero(np.append(True, part[runs][1:] != part[runs][:-1])[: len(runs)])
    ends, rows = np.append(runs, len(part)), []
    for a, b in zip(first, np.append(first[1:], len(runs))):
        at, lo, hi = runs[a:b], ends[a], ends[b]
        small = (zlib.compress(x.tobytes(), 1) for x in (size[at], counts[a:b], ranks[lo:hi]))
        rows.append((int(part[lo]), node[at].tobytes(), next(small), next(small), hashes[lo:hi].tobytes(), next(small)))
    return pd.DataFrame(rows, columns=["part", *PACK])


def _unpack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, size, hash and rank of each shingle."""
    column = lambda c, t: np.concatenate([np.frombuffer(zlib.decompress(x) if c in DEFLATED else x, t) for x in rows[c]])
    nodes, sizes, counts, hashes, ranks = (column(c, t) for c, t in PACK.items())
    return np.repeat(nodes, counts), np.repeat(sizes, counts), hashes, ranks


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def _distinct(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, size and hash of each shingle, by hash and node, each once."""
    node, size, hashes, _ = _unpack(rows)
    order = np.lexsort((node, hashes))
    node, size, hashes = node[order], size[order], hashes[order]
    once = np.append(True, (hashes[1:] != hashes[:-1]) | (node[1:] != node[:-1]))[: len(node)]  # rows of one set are one node
    return node[once], size[once], hashes[once]


def _rank(n: np.ndarray) -> np.ndarray:
    """How frequent, in a byte: an eighth of a power of two."""
    return np.minimum(np.rint(8 * np.log2(n)), 255).astype(np.uint8)


def _shared(rows: pd.DataFrame, parts: int, counts: pd.DataFrame | None = None) -> pd.DataFrame:
    """The shingles of a part that several nodes have, with their ranks, dealt by node; counts: of the whole part, if rows are a chunk of it."""
    node, size, hashes = _distinct(rows)
    if counts is None:
        n = np.diff(np.append(_starts(hashes), len(hashes)))
        n = np.repeat(n, n)
    else:
        known, total = (np.frombuffer(counts[c].iloc[0], t) for c, t in (("hashes", np.uint64), ("ns", np.int64)))
        n = total[np.searchsorted(known, hashes)]
    node, size, hashes, n = (x[n > 1] for x in (node, size, hashes, n))
    return _pack(_part(node.view(np.uint64), parts), node, size, hashes, _rank(n))


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk's shingles and how many nodes of it have them."""
    _, _, hashes = _distinct(rows)
    at = _starts(hashes)
    return pd.DataFrame({"part": rows["part"].iloc[:1].to_numpy(), "hashes": [hashes[at].tobytes()], "ns": [np.diff(np.append(at, len(hashes))).astype(np.int64).tobytes()]})


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    hashes, ns = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("hashes", np.uint64), ("ns", np.int64)))
    hashes, of = np.unique(hashes, return_inverse=True)
    total = np.zeros(len(hashes), np.int64)
    np.add.at(total, of, ns)
    return pd.DataFrame({"part": rows["part"].iloc[:1].to_numpy(), "hashes": [hashes.tobytes()], "ns": [total.tobytes()]})


def _prefixes(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Nodes with enough shared shingles to have a similar one: size, prefix, all shared shingles."""
    node, size, hashes, ranks = _unpack(rows)
    order = np.lexsort((hashes, ranks, node))
    node, size, hashes = node[order], size[order], hashes[order]
    at = _starts(node)
    shared = np.diff(np.append(at, len(node)))
    # rounded so that the product's last bit can't shorten a prefix
    prefix = shared - np.ceil(similarity * size[at] - 1e-9).astype(np.int64) + 1  # without those of one node alone, which come first
    found = [(node[i], size[i], hashes[i : i + k].view(np.int64), hashes[i : i + m].tobytes()) for i, k, m in zip(at, prefix, shared) if k > 0]
    return pd.DataFrame(found, columns=["node", "n", "prefix", "hashes"])


PACKED = ", ".join(f"{c} binary" for c in PACK)


def packed_shingles(sets: DataFrame, parts: int) -> DataFrame:
    """part, chunk and packed shingles; chunk is null but in parts that are too large, which are dealt again by node."""
    whole, split = _packed(sets, parts)
    return whole if split is None else whole.unionByName(split)


def _loads(nodes: DataFrame, parts: int) -> DataFrame:
    """part and m, the shingles in it, of a ``node_table``; parts: a power of two, at most ``CELLS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            for c in b.column("cells"):
                n += np.frombuffer(zlib.decompress(c.as_buffer()), np.uint32)
        n = n.reshape(parts, -1).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["part", "m"])

    return nodes.where("cells is not null").select("cells").mapInArrow(run, "part int, m long")


def _packed(sets: DataFrame, parts: int, shingle: int | None = None, loads: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``packed_shingles`` that are not split, and those that are, if any.

    If ``shingle`` is given, sets are those of texts, rows of ``with_hash``, and made in the task
    that packs them. loads: part and m, counts that add up to its shingles; else they are counted here.
    """
    made = (lambda batches: batches) if shingle is None else (lambda batches: _shingled(batches, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            size = np.array([len(s) for s in found.values()], np.int32)
            hashes = np.concatenate(list(found.values()))
            rows = _pack(_part(hashes, parts), np.repeat(np.array(list(found), np.int64), size), np.repeat(size, size), hashes, np.zeros(len(hashes), np.uint8))
            arrays = [pa.array(rows["part"], pa.int32()), *(pa.array(rows[c].tolist(), pa.binary()) for c in PACK)]
            return pa.RecordBatch.from_arrays(arrays, ["part", *PACK])

        found, held = {}, 0
        for b in made(batches):
            for node, s in zip(b.column("node").to_pylist(), b.column("hashes")):
                if s.is_valid and node not in found:
                    found[node] = np.frombuffer(s.as_buffer(), np.uint64)
                    held += len(found[node])
                if held >= BUFFER:
                    yield packed()
                    found, held = {}, 0
            if found:  # its arrays are the batch's
                yield packed()
                found, held = {}, 0

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in made(batches):
            n = np.zeros(parts, np.int64)
            for s in b.column("hashes").drop_null():
                n += np.bincount(_part(np.frombuffer(s.as_buffer(), np.uint64), parts), minlength=parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["part", "m"])

    rows = sets.select("node", "hashes") if shingle is None else sets
    packed = rows.mapInArrow(run, f"part int, {PACKED}")
    if loads is None:
        loads = rows.mapInArrow(load, "part int, m long")
    large = loads.groupBy("part").agg(F.sum("m").alias("m")).where(F.col("m") > 2 * TASK_ENTRIES)
    hot = materialise(large.select("part", F.ceil(F.col("m") / TASK_ENTRIES).cast("int").alias("chunks")), "hot")
    none = F.lit(None).cast("int").alias("chunk")
    if hot.isEmpty():
        return packed.select("part", none, *PACK), None

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            for part, chunks, *row in t[["part", "chunks", *PACK]].itertuples(index=False):
                node, size, hashes, ranks = _unpack(pd.DataFrame([row], columns=list(PACK)))
                made = _pack((node.view(np.uint64) % np.uint64(chunks)).astype(np.int32), node, size, hashes, ranks)
                yield made.rename(columns={"part": "chunk"}).assign(part=np.int32(part))[["part", "chunk", *PACK]]

    split = packed.join(hot, "part").mapInPandas(deal, f"part int, chunk int, {PACKED}")
    return packed.join(hot, "part", "left_anti").select("part", none, *PACK), split


def shared_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """node, n, prefix array<long>, hashes binary: what may have a similar node. Intersections need shared shingles only.

    sets: node, n and hashes, written; rows of one node may be several.
    """
    parts = max(1, math.ceil((sets.agg(F.sum("n")).first()[0] or 0) / TASK_ENTRIES))
    return _shared_sets(*_packed(sets, parts), parts, similarity)


def shared_sets_of(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``shared_sets`` of documents, whose sets are made again and not written; nodes: their ``node_table``, written."""
    tasks = math.ceil((nodes.agg(F.sum("entries")).first()[0] or 0) / TASK_ENTRIES)
    parts = 1 << max(0, tasks - 1).bit_length()
    loads = _loads(nodes, parts) if parts <= CELLS else None
    return _shared_sets(*_packed(with_hash(docs), parts, shingle, loads), parts, similarity)


def _shared_sets(whole: DataFrame, split: DataFrame | None, parts: int, similarity: float) -> DataFrame:
    dealt = whole.groupBy("part").applyInPandas(lambda t: _shared(t, parts), f"part int, {PACKED}")
    if split is not None:
        split = materialise(split, "split")
        key, schema = ["part", "chunk"], "part int, hashes binary, ns binary"
        counts = split.groupBy(*key).applyInPandas(_counted, schema).groupBy("part").applyInPandas(_summed, schema)
        counts = materialise(split.select(*key).distinct().join(counts, "part"), "counts")  # written, so that the cogroup's sides are two tables
        attach = lambda t, n: _shared(t, parts, n)
        dealt = dealt.unionByName(split.groupBy(*key).cogroup(counts.groupBy(*key)).applyInPandas(attach, f"part int, {PACKED}"))
    return dealt.groupBy("part").applyInPandas(lambda t: _prefixes(t, similarity), "node long, n int, prefix array<long>, hashes binary")


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v), u > v, that connect all nodes that can be similar by a shingle of their prefixes.

    Sizes fall into classes of a factor 1 / similarity. Among nodes that have a shingle in their
    prefix and are of one class, those with room for a node of their own size give the least node
    as anchor, the least size and the largest size that one of them has room for.
    """
    place = F.col("n") - F.octet_length("hashes") / 8 + F.col("k")  # shingles of the node alone come first
    most = F.floor((F.col("n") - place) * ((1 + similarity) / similarity) - F.col("n") + 1e-6).cast("int")
    size_class = F.floor(F.log("n") / math.log(1 / min(similarity, 0.99))).cast("int")
    rows = sets.select("node", "n", "hashes", F.posexplode("prefix").alias("k", "h")).select("h", size_class.alias("class"), "node", "n", most.alias("most"))
    anchors = rows.where("most >= n").groupBy("h", "class").agg(F.min("node").alias("anchor"), F.min("n").alias("least"), F.max("most").alias("room"), F.count(F.lit(1)).alias("m"))
    probes = rows.select("h", "node", "n", "most", F.explode(F.array("class", F.col("class") - 1)).alias("class"))
    met = probes.join(anchors, ["h", "class"]).where("node <> anchor and most >= least and room >= n")
    return met.select(F.greatest("node", "anchor").alias("u"), F.least("node", "anchor").alias("v")).distinct()


def _links_of(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], known: np.ndarray, similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs whose sets are similar enough, which connect all such pairs with what is ``known`` to be one component; only across sides, if given."""
    of = np.unique(known, return_inverse=True)[1]
    if not len(of) or (of == of[0]).all():
        return []
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    _, hashes, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    hashes, n = hashes.astype(np.int32), n.astype(np.int32)
    typical = np.add.reduceat(n[hashes], starts, dtype=np.int64) / sizes
    # shingles in order of how many nodes here have them; most: the largest partner with which a shingle can be the first shared one
    owner = np.repeat(np.arange(len(nodes), dtype=np.int32), lengths)
    hashes = hashes[np.lexsort((hashes, n[hashes], owner))]
    most = np.repeat(lengths + starts, lengths) - np.arange(len(hashes))  # shingles from here on
    most = (most * ((1 + similarity) / similarity) - sizes[owner] + 1e-6).astype(np.int32)
    able = np.flatnonzero((most >= similarity * sizes[owner] - 1e-6) & (n[hashes] > 1))
    first, last = np.searchsorted(owner[able], np.arange(len(nodes))), np.searchsorted(owner[able], np.arange(len(nodes)), "right")
    posted = able[np.argsort(hashes[able], kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(hashes[able], minlength=len(n))))
    done, mark, edges = np.zeros(len(nodes), bool), np.zeros(len(n), bool), []
    largest = np.bincount(of).argmax()
    left = (of != largest).sum()  # to do and outside the largest component
    for i in np.argsort(-typical, kind="stable"):
        if not left:  # of two apart, one was outside and has met the other
            break
        done[i] = True
        left -= of[i] != largest
        at = able[first[i] : last[i]]
        if not len(at):
            continue
        lo, width = ends[hashes[at]], ends[hashes[at] + 1] - ends[hashes[at]]
        to = np.cumsum(width) - width
        found = posted[np.arange(width.sum()) + np.repeat(lo - to, width)]
        fits = (sizes[owner[found]] <= np.repeat(most[at], width)) & (most[found] >= sizes[i])
        others = np.unique(owner[found[fits]])
        others = others[~done[others] & (of[others] != of[i])]
        if side is not None:
            others = others[side[others] != side[i]]
        if not len(others):
            continue
        mine, width = hashes[starts[i] : starts[i] + lengths[i]], lengths[others]
        to = np.cumsum(width) - width
        mark[mine] = True
        common = np.add.reduceat(mark[hashes[np.arange(width.sum()) + np.repeat(starts[others] - to, width)]], to, dtype=np.int64)
        mark[mine] = False
        linked = others[common / (sizes[i] + sizes[others] - common) >= similarity]
        if len(linked):
            heads, at = np.unique(of[linked], return_index=True)
            edges += [(nodes[i], nodes[j]) for j in linked[at]]
            of[np.isin(of, heads)] = of[i]
            largest = np.bincount(of).argmax()
            left = (~done & (of != largest)).sum()
    return edges


def _verified(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    edges = []
    for _, t in rows.groupby("root", sort=False):
        side = t["side"].to_numpy(np.int64)
        edges += _links_of(t["node"].to_numpy(np.int64), t["n"].to_numpy(np.int64), [np.frombuffer(h, np.uint64) for h in t["hashes"]], t["known"].to_numpy(np.int64), similarity, side if (side != side[0]).any() else None)
    edges = np.array(edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": edges.max(axis=1, initial=-(2**63)), "v": edges.min(axis=1, initial=2**63 - 1)})


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (u, v), those whose sets are similar enough."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("hashes").alias(f"h_{end}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, g, h in zip(*(b.column(c) for c in ("n_u", "n_v", "h_u", "h_v"))):
                common = len(np.intersect1d(np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64), assume_unique=True))
                keep.append(common / (n.as_py() + m.as_py() - common) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(run, "u long, v long")


def _print_links(distinct: DataFrame, sets: DataFrame, similarity: float, budget: int) -> DataFrame:
    """Edges (u, v), u > v, of similar nodes that the trie join of their fingerprints finds. distinct: node, print."""
    heads = materialise(distinct.groupBy("print").agg(F.min("node").alias("head")), "heads")
    near = links(heads.select(F.col("print").alias("fp")), budget)
    of = lambda name, end: heads.select(F.col("print").alias(name), F.col("head").alias(end))
    across = near.join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    alike = distinct.join(heads, "print").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = materialise(across.unionByName(alike).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "pairs")
    return similar_pairs(pairs, sets, similarity)


def similar_links(sets: DataFrame, stars: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v), u > v, that with the stars of ``known`` connect all similar nodes, and no others; stars: what may be similar."""
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    rows = sets.drop("prefix").join(members, "node").join(known.select(F.col("u").alias("node"), F.col("v").alias("_known")), "node", "left")
    rows = materialise(rows.select("root", "node", "n", "hashes", F.coalesce("_known", "node").alias("known")), "candidates")
    entries = F.sum(F.octet_length("hashes") / 8).cast("long")
    total, share = rows.agg(entries).first()[0] or 0, max(1, int(COMPARED * TASK_ENTRIES))
    large = rows.groupBy("root").agg(entries.alias("m")).where(F.col("m") > share)
    hot = materialise(large.select("root", (F.ceil(F.col("m") / share) + 1).cast("int").alias("chunks")), "hot")
    rows = rows.join(hot, "root", "left")
    bin_ = F.pmod(F.xxhash64("root"), F.lit(max(1, math.ceil(total / share))))
    columns = ["root", "node", "n", "hashes", "known"]
    cold = rows.where("chunks is null").select(*columns, F.lit(0).alias("side"), F.concat_ws(":", F.lit("c"), bin_).alias("task"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    split = rows.where("chunks is not null").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    task = F.concat_ws(":", F.lit("h"), "root", F.least("mine", "other"), F.greatest("mine", "other"))  # a chunk with itself, or two across
    split = split.select(*columns, F.col("mine").alias("side"), task.alias("task"))
    return cold.unionByName(split).groupBy("task").applyInPandas(lambda t: _verified(t, similarity), "u long, v long")


def _similar(docs: DataFrame, shingle: int, similarity: float, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), distinct fp with its first row, and the stars of similar ones; fp is a node."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    nodes = materialise(node_table(docs, shingle), "nodes")
    base = nodes.select("doc_id", "text_hash", F.col("node").alias("fp"), "print")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    distinct = base.groupBy("fp").agg(first.alias("first"))
    with shuffles_removed(docs.sparkSession):  # packed shingles are most of the stage's disk
        sets = materialise(shared_sets_of(docs, nodes, shingle, similarity), "sets")
    # only what shares enough shingles can be similar to anything
    able = base.groupBy(F.col("fp").alias("node")).agg(F.min("print").alias("print")).join(sets.select("node"), "node", "left_semi")
    known = components(_print_links(materialise(able, "prints"), sets, similarity, budget))
    more = similar_links(sets, components(candidates(sets, similarity)), known, similarity)
    return base, distinct, components(known.unionByName(more))


def similar_groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, budget: int = 4) -> DataFrame:
    """doc_id and component_id: the smallest doc_id that links of at least this similarity reach. The trie join's budget doesn't change them."""
    base, distinct, stars = _similar(docs, shingle, similarity, budget)
    return _with_least(base, distinct, stars).select("doc_id", F.col("component_id.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, budget: int = 4, spare_unnamed: bool = True) -> DataFrame:
    """Keep one row of each group: of its smallest doc_id, the row of the least text hash, once.

    Rows without doc_id come last; if they are spared, all of them stay and take no other's place.
    What stays is decided on ids and hashes; of texts, only those of rows to keep are moved.
    """
    base, distinct, stars = _similar(docs, shingle, similarity, budget)
    stay = _least(distinct, stars).select("component_id.doc_id", "component_id.text_hash").distinct()
    alike = base.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_copies"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_hash").eqNullSafe(F.col("text_hash"))
    stay = stay.join(alike.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_copies"), same).select("_id", "_hash", "_copies")
    if spare_unnamed:
        stay = stay.where("_id is not null")
    stay = materialise(stay, "stay")
    # the rows as they are, in a struct, so that no column's name can clash
    mine = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = mine.join(stay.where("_copies = 1"), same, "left_semi").select("_row.*")
    several = stay.where("_copies > 1")
    if not several.isEmpty():  # rows alike in both: one of each, picked before they are shuffled
        plain = [F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        one = mine.join(several, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("_row", F.xxhash64(*plain)).alias("_row"))
        kept = kept.unionByName(one.select("_row.*"))
    return kept.unionByName(docs.where("doc_id is null")) if spare_unnamed else kept
