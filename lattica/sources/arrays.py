"""One JSON array, read by many tasks.

An array can't be split at line ends, since it may be a single line, nor at brackets, since a
block of a file doesn't know whether it starts within a text or how deep in brackets. So it is
read in two steps. The file comes in records that end at ``}``, which Spark splits by bytes like
lines. First, each block reports its effect for either start, outside or within a text: how many
quotes it has, how much deeper it ends, and how many separators it has at each depth. Combined in
order, these effects give each block its true start: within a text or not, the depth, and the
number of elements before it. Then each block cuts its own elements and numbers them. An element
that lies across a border is put together out of what its blocks have of it, a row from each;
nothing else is shuffled.

Defined cases: elements are returned as canonical JSON, ord counts from 0 in file order, over
several files in the order of their names; an empty array has no rows; a file that is no array,
is cut off, or has something after its end raises when it is read, a malformed element where it
is used. A block is scanned in slices, so memory follows the block. Elements without any ``}``
for 2 GB are too much for the reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialise

#: Bytes that are scanned at a time, and blocks whose states are broadcast: some 100 bytes each.
SLICE, MOST_BLOCKS = 4 << 20, 200_000
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_COUNTS = "array<struct<depth:int,n:bigint>>"


def _quotes(a: np.ndarray) -> np.ndarray:
    """Where quotes are that no backslash escapes."""
    quote, slash = a == ord('"'), np.flatnonzero(a == ord("\\"))
    if len(slash):
        first = np.append(True, np.diff(slash) != 1)
        odd = (slash - slash[first][np.cumsum(first) - 1]) % 2 == 0  # the first, third ... of a run escapes what follows
        after = slash[odd] + 1
        quote[after[after < len(a)]] = False
    return quote


def _slices(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Offset and bytes of slices, which end after a ``}``, so never within an escape."""
    at = 0
    while at < len(data):
        end = data.rfind(b"}", at, at + SLICE) + 1 or data.find(b"}", at) + 1 or len(data)
        yield at, np.frombuffer(data, np.uint8, end - at, at)
        at = end


def _effect(data: bytes) -> tuple[int, list[int], list[dict[int, int]]]:
    """Parity of quotes; for a start outside and within a text, the change of depth and the ends of elements at each depth."""
    odd, depth, ends = 0, [0, 0], [{}, {}]
    for _, a in _slices(data):
        quote = _quotes(a)
        within = (np.cumsum(quote) + odd) & 1
        for start in (0, 1):
            outside = (within == start) & ~quote
            step = np.where(outside, _STEP[a], 0).astype(np.int32)
            deep = np.cumsum(step) + depth[start]
            # a comma ends an element of its depth, a bracket one of the depth that it closes
            closed = np.concatenate([deep[outside & (a == ord(","))], deep[step < 0] + 1])
            for d, n in zip(*(x.tolist() for x in np.unique(closed, return_counts=True))):
                ends[start][d] = ends[start].get(d, 0) + n
            depth[start] = int(deep[-1])
        odd = int(within[-1])
    return odd, depth, ends


def _cut(data: bytes, within: bool, depth: int, number: int) -> Iterator[tuple[int, bytes, bool]]:
    """Element number, text and whether it is whole, of what a block has of the array's elements."""
    cuts, kinds, odd = [], [], int(within)
    for at, a in _slices(data):
        quote = _quotes(a)
        inside = (np.cumsum(quote) + odd) & 1
        step = np.where((inside == 0) & ~quote, _STEP[a], 0).astype(np.int32)
        deep = np.cumsum(step) + depth
        comma = (a == ord(",")) & (inside == 0) & (deep == 1)
        opened, closed = (step > 0) & (deep == 1), (step < 0) & (deep == 0)
        found = np.flatnonzero(comma | opened | closed)
        cuts.append(found + at)
        kinds.append(np.where(opened[found], ord("["), np.where(closed[found], ord("]"), ord(","))))
        odd, depth = int(inside[-1]), int(deep[-1])
    last, whole, ended = 0, False, False
    for cut, kind in zip(np.concatenate(cuts).tolist(), np.concatenate(kinds).tolist()):
        text = data[last:cut]
        if kind == ord("["):
            if data[cut : cut + 1] != b"[" or ended or number or text.strip():
                raise ValueError("the file isn't one JSON array")
        else:
            if ended or not (text.strip() or not whole or (kind == ord("]") and not number)):
                raise ValueError("a JSON array has an empty element")
            if text.strip() or not whole:
                yield number, text, whole
            number += 1
        last, whole, ended = cut + 1, True, kind == ord("]")
    if not ended:
        yield number, data[last:], False
    elif data[last:].strip() != b"}":  # which the reader's last record hasn't
        raise ValueError("something follows the end of a JSON array")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """Each block's columns, and its bytes: records with the ``}`` that ended them."""
    held, of = [], None
    for b in batches:
        if not b.num_rows:
            continue
        values, rest = b.column(0), b.select(range(1, b.num_columns))
        key = np.array(rest.column(0).to_pylist()), rest.column(1).to_numpy()
        turns = np.flatnonzero(np.append(True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]))).tolist()
        for lo, hi in zip(turns, [*turns[1:], b.num_rows]):
            now = rest.slice(lo, 1).to_pylist()[0]
            if of is not None and (now["_f"], now["_b"]) != (of["_f"], of["_b"]):
                yield of, b"}".join([*held, b""])
                held = []
            of = now
            held.append(b"}".join([v.as_buffer().to_pybytes() for v in values[lo:hi]]))
    if of is not None:
        yield of, b"}".join([*held, b""])


def _records(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))


def block_states(spark: SparkSession, path: str) -> DataFrame:
    """_f and _b of each block with its true start: _within a text, _depth and _number of elements before; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, data in _blocks(batches):
            odd, depth, ends = _effect(data)
            counts = [[{"depth": d, "n": n} for d, n in e.items()] for e in ends]
            yield pa.RecordBatch.from_pylist([{"_f": of["_f"], "_b": of["_b"], "odd": odd, "d0": depth[0], "d1": depth[1], "e0": counts[0], "e1": counts[1]}], schema)

    counted = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64())]))
    schema = pa.schema([("_f", pa.string()), ("_b", pa.int64()), ("odd", pa.int32()), ("d0", pa.int32()), ("d1", pa.int32()), ("e0", counted), ("e1", counted)])
    rows = _records(spark, path).mapInArrow(run, f"_f string, _b long, odd int, d0 int, d1 int, e0 {_COUNTS}, e1 {_COUNTS}")
    rows = materialise(rows, "effects")  # a row for each block
    before = W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    mine = lambda name: F.when(F.col("_within"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    rows = rows.withColumn("_depth", F.coalesce(F.sum(mine("d")).over(before), F.lit(0)).cast("int"))
    ends = F.aggregate(F.filter(mine("e"), lambda e: e["depth"] + F.col("_depth") == 1), F.lit(0).cast("long"), lambda n, e: n + e["n"])
    rows = rows.withColumn("ends", ends)
    earlier = W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_number", F.coalesce(F.sum("ends").over(W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_total", F.coalesce(F.sum("ends").over(earlier), F.lit(0)) - F.col("_number"))
    states = materialise(rows.select("_f", "_b", "_within", "_depth", "_number", "_total", "odd", mine("d").alias("deeper")), "states")
    # the last record of a file ends without the } that its block gets all the same
    ended = states.groupBy("_f").agg((F.sum("odd") % 2).alias("odd"), F.sum("deeper").alias("depth"))
    if bad := ended.where("odd <> 0 or depth <> -1").first():
        raise ValueError(f"no JSON array, or one that is cut off: {bad['_f']}")
    return states.drop("odd", "deeper")


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """ord and raw of each element of a JSON array, in as many tasks as the file has blocks."""
    states = block_states(spark, path)
    records = _records(spark, path)
    if states.count() <= MOST_BLOCKS:
        records = records.join(F.broadcast(states), ["_f", "_b"])
    else:  # the order of a block's records doesn't survive a shuffle
        numbered = records.withColumn("_m", F.monotonically_increasing_id()).join(states, ["_f", "_b"])
        records = numbered.repartition("_f", "_b").sortWithinPartitions("_f", "_b", "_m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, data in _blocks(batches):
            rows, held = [], 0
            for number, text, whole in _cut(data, of["_within"], of["_depth"], of["_number"]):
                rows.append((of["_f"], of["_b"], of["_total"] + number, text.decode(), whole))
                held += len(text)
                if held >= SLICE:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["_f", "_b", "ord", "text", "whole"])

    found = records.select("value", "_f", "_b", "_within", "_depth", "_number", "_total").mapInArrow(run, "_f string, _b long, ord long, text string, whole boolean")
    across = found.where("not whole").groupBy("_f", "ord").agg(F.array_sort(F.collect_list(F.struct("_b", "text"))).alias("parts"))  # of neighbouring blocks
    across = across.select("ord", F.array_join(F.col("parts.text"), "").alias("text"))
    across = across.where(F.trim(F.regexp_replace("text", r"\s", "")) != "")  # no element but an empty array's
    return found.where("whole").select("ord", "text").unionByName(across).select("ord", F.to_json(F.parse_json("text")).alias("raw"))
