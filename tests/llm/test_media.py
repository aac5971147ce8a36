import hashlib
import random
import zlib

import numpy as np

from lattica.llm import media


def test_round_trip_and_ranges():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 64 * 64, 64 * 64 + 1, 64 * 200 + 7):
        payload = media.pad(rng.randbytes(n))
        assert len(payload) % 64 == 0 and payload
        stored = media.mux(payload)
        d = media.describe(stored)
        frames = len(payload) // 64
        assert d["error"] is None and d["codec"] == "raw " and (d["duration"], d["timescale"], d["samples"]) == (frames, 25, frames)
        assert media.stored_payload(stored) == payload
        assert [k["sample"] for k in d["keyframes"]] == list(range(0, frames, 16))
        for k in d["keyframes"]:
            assert stored[k["start"] : k["start"] + k["length"]] == payload[k["sample"] * 64 : k["sample"] * 64 + 64]


def test_other_layouts():
    # two chunks out of order, per-sample sizes, no sync table, an unknown box, 64-bit box size
    import struct

    a, b = b"AAAA", b"BBBBBB"
    table = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"xyz1", bytes(8))), media.full(b"stsz", struct.pack(">IIII", 0, 2, 4, 6)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), media.full(b"co64", struct.pack(">IQQ", 2, 22, 16)))
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + 10) + b + a
    stored = head + media.box(b"free", b"?") + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", bytes(16), struct.pack(">IQ", 1000, 77), bytes(4), version=1), media.box(b"minf", table))))
    d = media.describe(stored)
    assert (d["codec"], d["timescale"], d["duration"], d["error"]) == ("xyz1", 1000, 77, None)
    assert [(k["start"], k["length"]) for k in d["keyframes"]] == [(22, 4), (16, 6)] and media.stored_payload(stored) == a + b


def test_damaged():
    whole = media.mux(media.pad(b"hello" * 100))
    assert media.describe(None) is None and media.describe(b"")["error"] and media.describe(b"\0\0")["error"]
    rng = random.Random(2)
    for cut in range(0, len(whole), 13):
        d = media.describe(whole[:cut])
        assert d["error"]
    for _ in range(300):
        data = bytearray(whole)
        for _ in range(3):
            data[rng.randrange(700)] = rng.randrange(256)
        assert set(media.describe(bytes(data))) == set(media.DESCRIPTION.names)


def test_digest(spark):
    texts = [None, "", "abc", "é" * 100, "x" * 64, "x" * 300_000, "abc"]
    docs = spark.createDataFrame([(i, t, len((t or "").encode()), "clash") for i, t in enumerate(texts)] + [(None, "abc", 3, "")], "doc_id long, text string, n_bytes long, media string")
    got = media.digest(media.describe_media(media.mux_texts(docs), "media")).collect()
    assert len(got) == 8
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert by[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and by[i]["tail_crc32"] == zlib.crc32(payload[-64:]) and by[i]["payload_bytes"] == len(payload)
    assert {**by[2].asDict(), "doc_id": 6} == by[6].asDict() and by[0]["feature"] == by[1]["feature"]
    assert media.describe_media(docs.limit(0).selectExpr("doc_id", "cast(text as binary) as media"), "media").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, bytearray(b"xx"))], "id int, media binary")
    d = {r["id"]: r["description"] for r in media.describe_media(nulls, "media").collect()}
    assert d[1] is None and d[2]["error"]
    assert np.isfinite(1.0)


def fragmented(sizes, base, first_flags):
    """Two tracks, whose samples are all in fragments; the second track's lie between those of the first."""
    import struct

    trak = lambda i: media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, i)), media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), media.box(b"minf", media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), media.full(b"stsz", struct.pack(">II", 0, 0)), media.full(b"stsc", struct.pack(">I", 0)), media.full(b"stco", struct.pack(">I", 0)), media.full(b"stts", struct.pack(">I", 0))))))
    trex = lambda i: media.full(b"trex", struct.pack(">5I", i, 1, 40, 7, media.NON_SYNC))
    out = media.box(b"ftyp", b"iso5", bytes(4)) + media.box(b"moov", trak(1), trak(2), media.box(b"mvex", trex(1), trex(2)))
    wanted = []
    for part in sizes:
        where = len(out)
        flags = {"moof": 0x20000, "base": 0x1}[base]
        tfhd = lambda: media.full(b"tfhd", struct.pack(">I", 1), struct.pack(">Q", where) if base == "base" else b"", flags=flags)
        run = lambda at: media.full(b"trun", struct.pack(">Ii", len(part), at), struct.pack(">I", 0) if first_flags else b"", *(struct.pack(">I", n) for n in part), flags=0x201 | (4 if first_flags else 0))
        other = lambda: media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 2)), media.full(b"trun", struct.pack(">I", 1)))
        moof = lambda at: media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), media.box(b"traf", tfhd(), run(at)), other())
        at = len(moof(0)) + 8
        body = b"".join(bytes([65 + k % 26]) * n for k, n in enumerate(part))
        for k, n in enumerate(part):
            wanted.append((where + at + sum(part[:k]), n, bool(first_flags) and k == 0))
        out += moof(at) + media.box(b"mdat", body + bytes(7))
    return out, wanted


def test_fragments():
    for base in ("moof", "base"):
        for first_flags in (True, False):
            stored, wanted = fragmented([[5, 9, 4], [3], [8, 8]], base, first_flags)
            d = media.describe(stored)
            assert (d["error"], d["samples"], d["duration"], d["codec"]) == (None, 6, 240, "avc1")
            assert [(k["start"], k["length"]) for k in d["keyframes"]] == [(a, n) for a, n, key in wanted if key]
            assert media.stored_payload(stored) == b"".join(stored[a : a + n] for a, n, _ in wanted)
            for cut in range(0, len(stored), 7):
                assert set(media.describe(stored[:cut])) == set(media.DESCRIPTION.names)


def test_compact_sizes_and_summed_durations():
    import struct

    for bits, sizes in ((4, [3, 15, 1]), (8, [200, 0, 7]), (16, [300, 2])):
        table = {4: bytes([0x3F, 0x10]), 8: bytes([200, 0, 7]), 16: struct.pack(">HH", 300, 2)}[bits]
        stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"xyz1", bytes(8))), media.full(b"stz2", struct.pack(">II", bits, len(sizes)), table), media.full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), media.full(b"stco", struct.pack(">II", 1, 8)), media.full(b"stts", struct.pack(">III", 1, len(sizes), 20)))
        stored = media.box(b"mdat", bytes(sum(sizes))) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 90, 0, 0, 0)), media.box(b"minf", stbl))))
        d = media.describe(stored)
        assert d["error"] is None and d["duration"] == 20 * len(sizes)
        assert [(k["start"], k["length"]) for k in d["keyframes"]] == [(8 + sum(sizes[:k]), n) for k, n in enumerate(sizes)]
