"""Target-distribution importance resampling over a persisted count matrix.

Features are runs of 1 to ``longest`` consecutive words, and a feature's bucket is a hash of it.
``write_counts`` persists the document-by-bucket counts as a table of CSR blocks: each row of it
is a block of documents, with row pointers, column indices and counts as little-endian arrays
(``blocks_of`` reads them). All else reads that table: a column sum of the source's blocks and one of the target's give the two feature
distributions, their smoothed log ratio is a bucket's gain, and the product of each block with
the gains, which is sparse matrix times vector, gives the weights. Texts are read once.

A resample without replacement is the ``share`` of largest weight plus Gumbel noise, which
comes from a hash of seed and key, so that reruns agree. Ranks come from a scan over ranges of
the order; no task sees more than a range.

A block has at most ``BLOCK_ROWS`` documents and is closed at ``BLOCK_ENTRIES`` entries, and a
document has at most one entry for each bucket, so blocks are bounded however long texts are.
What reaches the driver is a count for each bucket and table, and the gains that go back.

Defined cases: a null or empty text has no words, no features and weight 0; repeated rows are
documents of their own; null keys have a noise of their own and come last among ties; an empty
source gives an empty result and an empty target counts zero everywhere. Other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ranked
from .common import materialise

BUCKETS = 10_000
#: Documents and entries of a block.
BLOCK_ROWS, BLOCK_ENTRIES = 256, 1 << 15
#: Words of a text that are hashed at a time.
SLICE = 1 << 16
#: A-Z lower-cased; what is neither an ASCII letter nor digit nor beyond ASCII separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = "doc_ids array<long>, n_words binary, indptr binary, indices binary, counts binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def bucket_counts(words: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features, ascending, and how many features each has."""
    crc, seen = zlib.crc32, []
    for at in range(0, len(words), SLICE):
        hashes = [crc(w) for w in words[at : at + SLICE]]
        found = [*hashes]
        for k in range(1, longest):  # a run of k + 1 words goes on where one of k ended
            hashes = [crc(w, crc(b" ", h)) for h, w in zip(hashes, words[at + k : at + k + SLICE])]
            found += hashes
        seen.append(np.unique(np.array(found, np.int64) % buckets, return_counts=True))
    if len(seen) == 1:
        return seen[0]
    total = np.zeros(buckets, np.int64)
    for at, n in seen:
        total[at] += n
    at = np.flatnonzero(total)
    return at, total[at]


def write_counts(docs: DataFrame, *, key: str = "doc_id", longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """The count matrix of ``key`` (a long) and ``text``, written as CSR blocks."""
    width = _column_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n_words, ends, indices, counts = [], [], [0], [], []

        def block() -> pa.RecordBatch:
            parts = (np.array(n_words, "<i8"), np.array(ends, "<i4"), np.concatenate([*indices, np.empty(0)]).astype(width), np.concatenate([*counts, np.empty(0)]).astype("<i4"))
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["doc_ids", "n_words", "indptr", "indices", "counts"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                at, n = bucket_counts(words, longest, buckets) if words else (np.empty(0), np.empty(0))
                keys.append(k)
                n_words.append(len(words))
                ends.append(ends[-1] + len(at))
                indices.append(at)
                counts.append(n)
                if len(keys) == BLOCK_ROWS or ends[-1] >= BLOCK_ENTRIES:
                    yield block()
                    keys, n_words, ends, indices, counts = [], [], [0], [], []
        if keys:
            yield block()

    return materialise(docs.select(F.col(key).cast("long"), "text").mapInArrow(run, BLOCK), "counts")


def _column_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<i4"


def blocks_of(batch: pa.RecordBatch, width: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, n_words, indptr, indices and counts of each block."""
    types = ("<i8", "<i4", width, "<i4")
    for row in range(batch.num_rows):
        parts = [np.frombuffer(batch.column(i + 1)[row].as_buffer(), t) for i, t in enumerate(types)]
        yield batch.column(0)[row].values, *parts


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has in all documents."""
    width = _column_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, n in zip(b.column(0), b.column(1)):
                # sums of less than 2**53 in doubles, so exact
                total += np.bincount(np.frombuffer(at.as_buffer(), width), np.frombuffer(n.as_buffer(), "<i4"), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = matrix.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in rows.collect():  # a row for each bucket at most
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed distributions, floored, of each bucket."""
    all_s, all_t = int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log(((t + 1) * float(all_s)) / ((s + 1) * float(all_t)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of gains over a document's features."""

    width = _column_type(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n_words, ends, indices, counts in blocks_of(b, width):
                both = np.stack([counts.astype(np.int64), counts * gain[indices]])
                n, total = np.diff(np.pad(np.cumsum(both, axis=1), ((0, 0), (1, 0)))[:, ends])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a key, times 1000 and floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, share: float = 0.25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = BUCKETS, target_key: str = "item_id") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null where it isn't drawn.

    Drawn are the ``share`` of largest score among documents of at least ``least_words`` words,
    numbered from 1, ties to the smaller doc_id.
    """
    if not 0 <= share <= 1:
        raise ValueError("the share must be between 0 and 1")
    matrix = write_counts(docs, longest=longest, buckets=buckets)
    gain = gains(column_sums(matrix, buckets), column_sums(write_counts(target, key=target_key, longest=longest, buckets=buckets), buckets))
    scored = materialise(weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    long = scored.where(F.col("n_words") >= least_words)
    take = math.floor(round(share * 1e6) * long.count() / 1e6)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    drawn = ranked(long, order).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
