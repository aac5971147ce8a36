"""Media columns: ISO base media containers in binary columns.

``describe_media`` walks the nested boxes of each container and decodes its sample tables
(sizes, also compact ones, chunks, chunk offsets, durations, sync samples) and those of its
fragments (track runs with their defaults) into codec, duration and the byte ranges of
keyframes; sample bytes are not decoded. ``mux`` stores any bytes as
a raw video track of 64-byte frames, and ``stored_payload`` reads a track's bytes back along
its sample tables.

Defined cases of ``describe_media``: null media give a null description; empty, cut off or
otherwise damaged containers give one whose ``error`` says what is wrong and whose other
fields hold what was read before; unknown boxes are skipped; several tracks are described by
the first that has samples; a track without a sync table has keyframes only; a duration that
the track's header leaves at 0 is the sum of the samples' durations. Other columns
are kept as they are, but for one named like the result. Equal media have equal descriptions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of a frame (8 x 8 samples of 8 bits) and frames a second of what mux() writes.
FRAME, RATE, SIDE = 64, 25, 8
#: Every so many frames is a keyframe, and so many frames are a chunk.
KEY_EVERY, CHUNK_FRAMES = 16, 64
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
MAX_DEPTH = 16

DESCRIPTION = T.StructType([
    T.StructField("brand", T.StringType()), T.StructField("codec", T.StringType()), T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("sample", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))), T.StructField("error", T.StringType()),
])


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(body)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(body)


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def pad(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of a frame."""
    return payload + bytes(-len(payload) % FRAME or (0 if payload else FRAME))


def mux(payload: bytes) -> bytes:
    """A container with one raw video track whose frames are the payload, a multiple of 64 bytes."""
    n, identity = len(payload) // FRAME, struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    chunks, last = -(-n // CHUNK_FRAMES), (n - 1) % CHUNK_FRAMES + 1
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, CHUNK_FRAMES, 1)] * (chunks > 1) + [(chunks, last, 1)]
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")

    def movie(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
        wide = bool(chunks) and int(offsets[-1]) >= 1 << 32
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)), full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), identity, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 1 << 16, 1 << 8), bytes(10), identity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    size = len(movie(0))
    gap = 16 if len(payload) + 8 >= 1 << 32 else 8
    moov = movie(len(head) + size + gap)
    if len(moov) != size:  # 64-bit offsets made it longer
        moov = movie(len(head) + len(moov) + gap)
    return head + moov + box(b"mdat", payload)


class Damaged(ValueError):
    pass


def walk(data: memoryview, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, depth, start and end of the body) of each box, those that hold boxes before what they hold."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Damaged("cut off in a box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Damaged("cut off in a box header")
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise Damaged(f"box {kind.decode('latin-1')} goes beyond its parent")
        yield kind, depth, body, stop
        if kind in NESTED:
            if depth >= MAX_DEPTH:
                raise Damaged("nested too deep")
            yield from walk(data, body, stop, depth + 1)
        start = stop


def _table(data: memoryview, at: int, end: int, dtype: str, width: int = 1) -> np.ndarray:
    """A counted table of big-endian numbers."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    if at + 8 + n * width * np.dtype(dtype).itemsize > end:
        raise Damaged("a table goes beyond its box")
    return np.frombuffer(data, dtype, n * width, at + 8).astype(np.int64).reshape(-1, width)


def _compact_sizes(data: memoryview, at: int, end: int) -> np.ndarray:
    """Sizes of 4, 8 or 16 bits each (stz2)."""
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16):
        raise Damaged("sizes of an unknown width")
    if at + 12 + (n * bits + 7) // 8 > end:
        raise Damaged("a table goes beyond its box")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, np.uint8 if bits == 8 else ">u2", n, at + 12).astype(np.int64)


#: A sample that isn't a keyframe, among its flags; then which optional fields tfhd and trun have, in their order.
NON_SYNC = 0x10000
TFHD_FIELDS = ((0x1, "base", 8), (0x2, "entry", 4), (0x8, "duration", 4), (0x10, "size", 4), (0x20, "flags", 4))
TRUN_FIELDS = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))


def _fragment_head(data: memoryview, at: int, end: int) -> dict:
    """track, has (which fields), and the fields of a tfhd box."""
    flags, track = struct.unpack_from(">II", data, at)
    out, at = {"track": track, "has": flags & 0xFFFFFF}, at + 8
    for bit, name, width in TFHD_FIELDS:
        if flags & bit:
            if at + width > end:
                raise Damaged("a fragment's head goes beyond its box")
            out[name] = int.from_bytes(data[at : at + width], "big")
            at += width
    return out


def _run(data: memoryview, at: int, end: int, default: dict, begin: int) -> dict:
    """starts, sizes, durations and sync of a trun box's samples; they lie from ``begin`` on if it doesn't say where."""
    flags, n = struct.unpack_from(">II", data, at)
    at, first = at + 8, None
    if flags & 0x1:
        begin = default["from"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 0x4:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    fields = [name for bit, name in TRUN_FIELDS if flags & bit]
    if at + 4 * len(fields) * n > end:
        raise Damaged("a track run goes beyond its box")
    if not fields and n > len(data):
        raise Damaged("more samples than bytes")
    table = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, -1)
    value = lambda name: table[:, fields.index(name)] if name in fields else np.full(n, default.get(name, 0), np.int64)
    sizes, marks = value("size"), value("flags").copy()
    if first is not None and n:
        marks[0] = first
    return {"starts": begin + np.cumsum(sizes) - sizes, "sizes": sizes, "durations": value("duration"), "sync": marks & NON_SYNC == 0, "end": begin + int(sizes.sum())}


def tracks(data: memoryview, into: dict) -> list[dict]:
    """The tables of each track; ``runs_in_fragments`` are those of its movie fragments."""
    found: list[dict] = []
    defaults: dict[int, dict] = {}
    movie = head = end_of_last = None
    for kind, _, at, end in walk(data):
        if kind == b"ftyp" and end - at >= 4:
            into["brand"] = bytes(data[at : at + 4]).decode("latin-1")
        elif kind == b"trak":
            found.append({})
        elif kind == b"trex":
            track, entry, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
            defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            movie = end_of_last = at - (8 if end - at + 8 < 1 << 32 else 16)
        elif kind == b"tfhd" and movie is not None:
            head = _fragment_head(data, at, end)
            head = defaults.get(head["track"], {}) | head
            head["from"] = head.get("base", movie if head["has"] & 0x20000 else end_of_last)
            end_of_last = head["from"]
        elif kind == b"trun" and head is not None:
            run = _run(data, at, end, head, end_of_last)
            end_of_last = run["end"]
            owner = next((t for t in found if t.get("id") == head["track"]), None)
            if owner is None:
                raise Damaged("a fragment of an unknown track")
            owner.setdefault("runs_in_fragments", []).append(run)
        elif not found:
            continue
        elif kind == b"tkhd":
            (found[-1]["id"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
        elif kind == b"mdhd":
            fmt, skip = (">IQ", 20) if data[at] == 1 else (">II", 12)
            found[-1]["timescale"], found[-1]["duration"] = struct.unpack_from(fmt, data, at + skip)
        elif kind == b"stsd":
            found[-1]["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            times = _table(data, at, end, ">u4", 2)
            found[-1]["lasting"] = int((times[:, 0] * times[:, 1]).sum())
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            if not same and at + 12 + 4 * n > end:
                raise Damaged("a table goes beyond its box")
            if same and n > len(data):
                raise Damaged("more samples than bytes")
            found[-1]["sizes"] = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
        elif kind == b"stz2":
            found[-1]["sizes"] = _compact_sizes(data, at, end)
        elif kind in (b"stco", b"co64"):
            found[-1]["chunks"] = _table(data, at, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stsc":
            found[-1]["runs"] = _table(data, at, end, ">u4", 3)
        elif kind == b"stss":
            found[-1]["sync"] = _table(data, at, end, ">u4")[:, 0]
    return found


def samples_of(track: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of all samples, of the movie and then of its fragments, and the numbers of keyframes from 0."""
    starts, sizes = sample_ranges(track)
    keys = track.get("sync", np.arange(1, len(sizes) + 1)) - 1
    if ((keys < 0) | (keys >= len(sizes))).any():
        raise Damaged("a keyframe beyond the samples")
    for run in track.get("runs_in_fragments", []):
        keys = np.append(keys, len(sizes) + np.flatnonzero(run["sync"]))
        starts, sizes = np.append(starts, run["starts"]), np.append(sizes, run["sizes"])
    return starts, sizes, keys


def n_samples(track: dict) -> int:
    return len(track.get("sizes", ())) + sum(len(run["sizes"]) for run in track.get("runs_in_fragments", []))


def sample_ranges(track: dict) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each sample in the container."""
    sizes, chunks, runs = track["sizes"], track["chunks"], track["runs"]
    if not len(sizes):
        return sizes, sizes
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise Damaged("sample-to-chunk runs are out of order")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)).clip(0))[: len(chunks)]
    if per_chunk.sum() != len(sizes):
        raise Damaged("chunks hold another number of samples")
    upto = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    return np.repeat(chunks - np.append(upto, 0)[first], per_chunk) + upto, sizes


def describe(media: bytes | pa.Buffer | None) -> dict | None:
    if media is None:
        return None
    data, out = memoryview(media), dict.fromkeys(DESCRIPTION.names)
    try:
        found = [t for t in tracks(data, out) if "sizes" in t]
        if not found:
            raise Damaged("no track with samples")
        track = next((t for t in found if n_samples(t)), found[0])
        lasting = track.get("lasting", 0) + sum(int(run["durations"].sum()) for run in track.get("runs_in_fragments", []))
        out |= {k: track.get(k) for k in ("codec", "timescale")} | {"duration": track.get("duration") or lasting, "samples": n_samples(track)}
        starts, sizes, keys = samples_of(track)
        if len(starts) and (starts.min() < 0 or (starts + sizes).max() > len(data)):
            raise Damaged("samples beyond the container")
        out["keyframes"] = [{"sample": int(k), "start": int(starts[k]), "length": int(sizes[k])} for k in keys]
    except KeyError as e:
        out["error"] = f"no {e.args[0]} table"
    except (Damaged, struct.error, IndexError) as e:
        out["error"] = str(e)
    return out


def stored_payload(media: bytes) -> bytes:
    """The samples of the first track that has any, read along its tables."""
    data = memoryview(media)
    starts, sizes, _ = samples_of(next(t for t in tracks(data, {}) if n_samples(t)))
    cuts = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1  # samples in a row are one range
    lo, hi = starts[np.append(0, cuts)], (starts + sizes)[np.append(cuts - 1, -1)]
    return b"".join(data[a:b] for a, b in zip(lo.tolist(), hi.tolist()))


def describe_media(df: DataFrame, media: str, into: str = "description") -> DataFrame:
    """Add a struct column that describes the containers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(DESCRIPTION)
        for batch in batches:
            made = pa.array([describe(v.as_buffer() if v.is_valid else None) for v in batch.column(media)], kind)
            kept = [n for n in batch.schema.names if n != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), made], [*kept, into])

    kept = [f for f in df.schema if f.name != into]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(into, DESCRIPTION)]))


#: Bytes of containers in one record batch, at the most unless one is larger.
BATCH_BYTES = 8 << 20


def mux_texts(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Store each text's UTF-8 bytes, padded, as a container; other columns but the text are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.drop_columns([n for n in batch.schema.names if n in (text, into)])
            made, held, at = [], 0, 0
            for i, v in enumerate(batch.column(text)):
                made.append(mux(pad(v.as_buffer().to_pybytes() if v.is_valid else b"")))
                held += len(made[-1])
                if held >= BATCH_BYTES or i + 1 == len(batch):
                    part = kept.slice(at, len(made))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*part.schema.names, into])
                    made, held, at = [], 0, i + 1

    kept = [f for f in df.schema if f.name not in (text, into)]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.BinaryType())]))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, description -> what identifies the stored form and what was read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, n_bytes, media, d in zip(rows["doc_id"], rows["n_bytes"], rows["media"], rows["description"]):
                back = stored_payload(media)
                keys = np.array([(k["start"], k["length"]) for k in d["keyframes"]], "<i8")
                feature = f"{d['brand']}|{d['codec']}|{d['duration']}/{d['timescale']}|samples={d['samples']}|keyframes={len(keys)}|ranges={zlib.crc32(keys.tobytes()):08x}"
                out.append((doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            frame = pd.DataFrame(out, columns=DIGEST.names)
            yield frame.astype({"doc_id": "Int64"})

    return df.select("doc_id", "n_bytes", "media", "description").mapInPandas(run, DIGEST)


DIGEST = T.StructType([T.StructField(n, T.StringType() if n in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
