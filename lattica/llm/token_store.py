"""Token-ID / binary output with a minimal perfect hash index.

``write_tokens`` lays out, in a folder of the shared store:

- ``shard-NNNNNN.ids``: nothing but token ids, little-endian, of 2 bytes each where the
  vocabulary allows and else 4, documents in ascending order of their key;
- ``shard-NNNNNN.off``: where each of these documents starts, and the last one ends, 8 bytes each;
- ``index-NNNNNN.mph``: of the keys that hash to one bucket, a minimal perfect hash function
  and, at each key's slot, a fingerprint of the key, the shard, row and offset of its first
  document, the ids this has and the number of the key's documents;
- ``manifest.json``: ids, documents and first id of each shard.

A lookup of one key reads the head of its bucket's index, one line of 64 bytes for each level
of the function that it looks at (1.6 on average), the slot of 32 bytes, and the ids at the
offset: as many bytes however large bucket and shard are (``read_document``, tested). Lines
hold the number of keys settled before them, so no other line is needed for a key's rank.
Whole tables are looked up bucket by bucket, and read in runs of neighbouring documents.
Equal keys lie next to each other, so one entry serves all their documents, however many;
they are read in pieces of ``PIECE`` documents, so no task gets all of a frequent key.

Each task writes under a name of its own attempt and renames at the end; tasks that run again
write the same bytes. Shards and buckets are sized by the data, up to ``MOST_FILES`` of each.

Defined cases: null and empty texts have the end id only; null keys come first, in a bucket
of their own; repeated rows are documents of their own; an empty table makes a manifest
without shards; unknown keys are not found, but for one in 2**32. Only the key, a long, and
the text are looked at.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, materialise
from .tokens import encoder

#: Bytes of text of a shard, and keys of an index bucket, unless MOST_FILES would not do.
SHARD_TEXT, BUCKET_KEYS, MOST_FILES = 16 << 20, 50_000, 200_000
GAMMA = 2.0
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("row", "<u4"), ("n_ids", "<u4"), ("offset", "<u8"), ("copies", "<u8")])
#: Bytes of a line of bits: a count of 8 bytes, then the bits.
LINE, LINE_BITS = 64, 56 * 8
#: Documents that are read as a unit, and ids that are held at a time.
PIECE, HELD_IDS = 4096, 1 << 20


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys, one to one for each seed (splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1. Each level is a bit array; keys alone at their bit settle there, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            size = max(2, math.ceil(GAMMA * len(keys)))
            at = (_mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 for some keys that weren't there."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        """A head of the level sizes, then each level in lines: the keys settled before, and 448 bits."""
        head = struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) for b in self.levels)
        out = [head]
        for bits, ranks in zip(self.levels, self.ranks):
            lines = -(-len(bits) // LINE_BITS)
            made = np.zeros((lines, LINE), np.uint8)
            made[:, :8] = ranks[::LINE_BITS].astype("<u8").view(np.uint8).reshape(-1, 8)
            made[:, 8:] = np.packbits(np.append(bits, np.zeros(lines * LINE_BITS - len(bits), np.uint8))).reshape(lines, -1)
            out.append(made.tobytes())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """And where its bytes end."""
        (n,) = struct.unpack_from("<I", data)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, 4), 4 + 8 * n, []
        for size in sizes:
            lines = -(-size // LINE_BITS)
            made = np.frombuffer(data, np.uint8, lines * LINE, at).reshape(lines, LINE)
            levels.append(np.unpackbits(made[:, 8:].ravel(), count=size))
            at += lines * LINE
        return cls(levels), at


def slot_of(key: int, read_at) -> np.void | None:
    """The slot of one key, by a few reads of an index file; ``read_at(n, offset)`` gives n of its bytes."""
    raw = np.array([key], np.int64).view(np.uint64)
    (n,) = struct.unpack("<I", read_at(4, 0))
    sizes, at = struct.unpack(f"<{n}Q", read_at(8 * n, 4)), 4 + 8 * n
    end = at + sum(-(-size // LINE_BITS) * LINE for size in sizes)
    for level, size in enumerate(sizes):
        bit = int(_mixed(raw, level)[0] % np.uint64(size))
        line, inside = divmod(bit, LINE_BITS)
        data = read_at(LINE, at + line * LINE)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, LINE - 8, 8))
        if bits[inside]:
            rank = struct.unpack_from("<Q", data)[0] + int(bits[:inside].sum())
            slot = np.frombuffer(read_at(SLOT.itemsize, end + rank * SLOT.itemsize), SLOT)[0]
            return slot if slot["fingerprint"] == fingerprints(raw)[0] else None
        at += -(-size // LINE_BITS) * LINE
    return None


@dataclass
class TokenStore:
    path: str
    width: int
    buckets: int
    id_base: list[int]
    rows: list[int]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2" if self.width == 2 else "<u4")


def open_store(path: str) -> TokenStore:
    fs, root = file_system(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    return TokenStore(path, m["width"], m["buckets"], [s["first_id"] for s in m["shards"]], [s["documents"] for s in m["shards"]])


def _put(fs, root: str, name: str, attempt: object) -> tuple[str, str]:
    fs.create_dir(root, recursive=True)
    return f"{root}/_{name}.{attempt}", f"{root}/{name}"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, key: str = "doc_id", text: str = "text") -> TokenStore:
    """Encode all texts, each followed by ``end_id``, and write the store at ``path``, a URI."""
    from .tokens import WordEncoder

    spark = docs.sparkSession
    width = 2 if max(WordEncoder(tokenizer).vocabulary - 1, end_id) < 1 << 16 else 4
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    shards = max(1, math.ceil(size / max(SHARD_TEXT, size / MOST_FILES)))
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("_t"), F.monotonically_increasing_id().alias("_r"))
    # rows alike in key and text give the same bytes in any order, and can be split by their place
    ordered = ordered.repartitionByRange(shards, "key", "_t", "_r").sortWithinPartitions("key", "_t").select("key", "text")
    entries = ordered.mapInArrow(lambda it: _write_shard(it, path, tokenizer, end_id, width), "key long, shard int, row int, start long, n_ids int")
    entries = materialise(entries, "entries")

    stats = {r["shard"]: r for r in entries.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("n_ids").alias("ids")).collect()}
    plan, first = [], 0
    for shard in range(max(stats, default=-1) + 1):
        n, ids = (stats[shard]["n"], stats[shard]["ids"]) if shard in stats else (0, 0)
        plan.append({"documents": n, "ids": ids, "first_id": first})
        first += ids
    buckets = max(1, math.ceil(rows / max(BUCKET_KEYS, rows / MOST_FILES)))
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": width, "buckets": buckets, "end_id": end_id, "shards": plan}).encode())

    at = F.min(F.struct("shard", "row", "start", "n_ids")).alias("at")
    keyed = entries.groupBy("key").agg(at, F.count(F.lit(1)).alias("copies")).select("key", "at.*", "copies", _bucket(buckets).alias("bucket"))
    built = keyed.groupBy("bucket").applyInPandas(lambda rows: _write_bucket(rows, path), "bucket int, keys long")
    built.agg(F.sum("keys")).collect()
    return open_store(path)


def _bucket(buckets: int):
    """Null keys have the last bucket to themselves."""
    return F.when(F.col("key").isNull(), F.lit(buckets)).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("int")


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    enc, context = encoder(tokenizer), TaskContext.get()
    shard = context.partitionId()
    fs, root = file_system(path)
    dtype, out, lengths, start = np.dtype("<u2" if width == 2 else "<u4"), None, [], 0
    for batch in batches:
        if not len(batch):
            continue
        if out is None:
            temp, final = _put(fs, root, f"shard-{shard:06d}.ids", context.taskAttemptId())
            out = fs.open_output_stream(temp)
        sizes = np.empty(len(batch), np.int64)
        for i, ids in enumerate(enc.encode(batch.column("text"))):
            sizes[i] = len(ids) + 1
            out.write(np.append(ids, end_id).astype(dtype).tobytes())
        before = sum(map(len, lengths))
        lengths.append(sizes.astype("<u4"))
        starts = start + np.cumsum(sizes) - sizes
        start += int(sizes.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(np.full(len(batch), shard, np.int32)), pa.array(np.arange(before, before + len(batch), dtype=np.int32)), pa.array(starts), pa.array(sizes.astype(np.int32))], ["key", "shard", "row", "start", "n_ids"]
        )
    if out is not None:
        out.close()
        fs.move(temp, final)
        temp, final = _put(fs, root, f"shard-{shard:06d}.off", context.taskAttemptId())
        with fs.open_output_stream(temp) as f:
            f.write(np.append(0, np.cumsum(np.concatenate(lengths), dtype=np.int64)).astype("<u8").tobytes())
        fs.move(temp, final)


def _write_bucket(rows: pd.DataFrame, path: str) -> pd.DataFrame:
    fs, root = file_system(path)
    bucket = int(rows["bucket"].iloc[0])
    keys = rows["key"].fillna(0).astype("int64").to_numpy().view(np.uint64)  # a bucket with nulls has no other key
    table = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = table.slots(keys)
    for name, of in (("shard", "shard"), ("row", "row"), ("copies", "copies"), ("offset", "start"), ("n_ids", "n_ids")):
        slots[name][at] = rows[of].to_numpy()
    slots["fingerprint"][at] = fingerprints(keys)
    temp, final = _put(fs, root, f"index-{bucket:06d}.mph", TaskContext.get().taskAttemptId())
    with fs.open_output_stream(temp) as f:
        f.write(table.to_bytes() + slots.tobytes())
    fs.move(temp, final)
    return pd.DataFrame({"bucket": [bucket], "keys": [len(keys)]})


def _find(path: str, bucket: int, keys: np.ndarray) -> np.ndarray:
    """Slots of the keys, those of unknown keys with no copies."""
    from pyarrow.fs import FileType

    fs, root = file_system(path)
    name, none = f"{root}/index-{bucket:06d}.mph", np.zeros(len(keys), SLOT)
    if fs.get_file_info(name).type == FileType.NotFound:
        return none
    with fs.open_input_stream(name) as f:
        data = f.read()
    table, end = PerfectHash.from_bytes(data)
    slots = np.frombuffer(data, SLOT, offset=end)
    at = table.slots(keys)
    found = slots[at.clip(0)]
    known = (at >= 0) & (found["fingerprint"] == fingerprints(keys))
    return np.where(known, found, none)


def lookup(keys: DataFrame, store: TokenStore, key: str = "doc_id") -> DataFrame:
    """key, shard, row, offset and copies of each distinct key that the store has."""
    path = store.path

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = rows["key"].fillna(0).astype("int64").to_numpy().view(np.uint64)
        found = _find(path, int(rows["bucket"].iloc[0]), raw)
        out = pd.DataFrame({"key": rows["key"], **{n: found[n].astype("int64") for n in ("shard", "row", "offset", "copies")}})
        return out[out["copies"] > 0]

    asked = keys.select(F.col(key).cast("long").alias("key")).distinct().withColumn("bucket", _bucket(store.buckets))
    return asked.groupBy("bucket").applyInPandas(run, "key long, shard long, row long, offset long, copies long")


def read_tokens(found: DataFrame, store: TokenStore) -> DataFrame:
    """A row per document of what lookup found: key, start among all ids, n_tokens, ids (4 bytes each)."""
    n = max(1, min(len(store.rows), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE)))
    pieces = found.select("key", "shard", "row", "copies", pieces.alias("piece"))
    placed = pieces.select("key", "shard", "piece", (F.col("row") + F.col("piece") * PIECE).alias("row"), F.least(F.lit(PIECE), F.col("copies") - F.col("piece") * PIECE).alias("n"))
    placed = placed.repartition(n, "shard", "piece").sortWithinPartitions("shard", "row")
    return placed.mapInArrow(lambda it: _read(it, store), "key long, start long, n_tokens long, ids binary")


def _runs(batches: Iterator[pa.RecordBatch], store: TokenStore) -> Iterator[tuple[int, int, list]]:
    """(shard, first row, keys) of documents that lie next to each other, at most PIECE of them."""
    shard, first, keys = -1, 0, []
    for rows in batches:
        for r in rows.to_pylist():
            at, row, left = r["shard"], r["row"], r["n"]
            while left:
                while row >= store.rows[at]:  # copies of a key go on in the next shard
                    at, row = at + 1, row - store.rows[at]
                n = min(left, store.rows[at] - row)
                if (at, row) != (shard, first + len(keys)) or len(keys) + n > PIECE:
                    if keys:
                        yield shard, first, keys
                    shard, first, keys = at, row, []
                keys += [r["key"]] * n
                row, left = row + n, left - n
    if keys:
        yield shard, first, keys


def _read(batches: Iterator[pa.RecordBatch], store: TokenStore) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(store.path)
    names = ["key", "start", "n_tokens", "ids"]
    opened: dict = {}
    for shard, first, keys in _runs(batches, store):
        if opened.get("shard") != shard:
            for f in opened.get("files", ()):
                f.close()
            opened = {"shard": shard, "files": [fs.open_input_file(f"{root}/shard-{shard:06d}.{kind}") for kind in ("off", "ids")]}
        offsets, ids = opened["files"]
        edges = np.frombuffer(offsets.read_at(8 * (len(keys) + 1), 8 * first), "<u8").astype(np.int64)
        at = 0
        while at < len(keys):  # as many documents as HELD_IDS has room for, one at least
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + HELD_IDS, "right")) - 1)
            raw = ids.read_at(int(edges[upto] - edges[at]) * store.width, int(edges[at]) * store.width)
            wide = raw if store.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            cuts = ((edges[at : upto + 1] - edges[at]) * 4).astype(np.int32)
            # the ids as they lie, cut at these places: no object for each document
            parts = pa.Array.from_buffers(pa.binary(), upto - at, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(wide)])
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:upto], pa.int64()), pa.array(store.id_base[shard] + edges[at:upto]), pa.array(np.diff(edges[at : upto + 1])), parts], names)
            at = upto
    for f in opened.get("files", ()):
        f.close()


def read_document(store: TokenStore, key: int | None, seen: list[int] | None = None) -> list[np.ndarray]:
    """Ids of all documents with a key, by one lookup; ``seen`` gets the number of bytes of each read."""
    import xxhash
    from pyarrow.fs import FileType

    bucket = store.buckets
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        bucket = (h - (h >> 63 << 64)) % store.buckets
    fs, root = file_system(store.path)

    def reader(name: str):
        f = fs.open_input_file(f"{root}/{name}")

        def read_at(n: int, offset: int) -> bytes:
            if seen is not None:
                seen.append(n)
            return f.read_at(n, offset)

        return read_at

    index = f"index-{bucket:06d}.mph"
    slot = None if fs.get_file_info(f"{root}/{index}").type == FileType.NotFound else slot_of(key or 0, reader(index))
    if slot is None:
        return []
    shard, row, offset, n, copies, out = *(int(slot[k]) for k in ("shard", "row", "offset", "n_ids", "copies")), []
    while copies:
        while row >= store.rows[shard]:
            shard, row, offset, n = shard + 1, 0, 0, None
        if n is None:  # only the first document's place is in the slot
            offset, end = np.frombuffer(reader(f"shard-{shard:06d}.off")(16, 8 * row), "<u8").tolist()
            n = end - offset
        out.append(np.frombuffer(reader(f"shard-{shard:06d}.ids")(n * store.width, offset * store.width), store.dtype).astype("<u4"))
        row, copies, n = row + 1, copies - 1, None
    return out


def crc_of_ids(read: DataFrame) -> DataFrame:
    """The ids' digest instead of the ids."""
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
