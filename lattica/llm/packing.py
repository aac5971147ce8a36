"""Hierarchical multi-length packing.

Documents (their ids and an end id) are routed to context-size tiers: whole windows of the
longest tier are cut off first, and what is left goes to the smallest tier that holds it. A
window opens with a document of its own tier; its gap is filled from shorter tiers, with the
largest piece that fits as long as one does, then with a cut piece, so that windows are full.
What can't be filled within a pool of documents goes on into the next one; at the end of a
task the rest is laid out in full windows of ever smaller tiers, and what is smaller than the
smallest tier in ever smaller powers of two, so nothing is padded. Step groups get equal numbers of tokens: full windows, the
longest first, go to the open group that has the fewest.

Each task packs its own rows, without a shuffle, in memory bounded by the pool and the longest
document. Sequence ids are unique and the same when a task runs again.

Defined cases: null and empty texts are their end id; repeated rows and null doc_ids are
documents of their own; an empty table gives an empty one. Only doc_id and text are looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

TIERS = (128, 256, 512, 1024, 2048)
#: Tokens of documents that are packed together, and of a step group.
POOL, STEP_TOKENS, OPEN_GROUPS = 1 << 20, 32 * 2048, 8
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids_crc32 long, ids binary"

#: length, serial, document, start, ids: sorts by length.
Piece = tuple[int, int, tuple, int, np.ndarray]


class Packer:
    """Takes documents, gives sequences: lists of pieces, each list full but the very last."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self.tiers, self.most, self.pool = sorted(tiers), max(tiers), pool
        self.waiting: list[list[Piece]] = [[] for _ in self.tiers]
        self.held = self.serial = 0

    def _route(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        if len(ids):
            self.serial += 1
            tier = next(i for i, t in enumerate(self.tiers) if t >= len(ids))
            insort(self.waiting[tier], (len(ids), self.serial, doc, start, ids), key=lambda p: p[:2])

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list[Piece]]:
        whole = len(ids) // self.most * self.most
        for at in range(0, whole, self.most):
            self.serial += 1
            yield [(self.most, self.serial, doc, at, ids[at : at + self.most])]
        self._route(doc, whole, ids[whole:])
        self.held += len(ids) - whole
        if self.held >= self.pool:
            yield from self.pack()

    def _fill(self, gap: int) -> list[Piece]:
        """Pieces for a gap: the largest that fit, then a cut one; fewer if there are no more."""
        out = []
        while gap:
            best = None
            for tier in reversed(self.waiting):
                if (k := bisect_right(tier, gap, key=lambda p: p[0])) and (best is None or tier[k - 1][0] > best[0][best[1]][0]):
                    best = (tier, k - 1)
            if best is not None:
                piece = best[0].pop(best[1])
                out.append(piece)
                gap -= piece[0]
                continue
            tier = next((t for t in self.waiting if t), None)  # all are longer: cut the shortest
            if tier is None:
                break
            n, serial, doc, start, ids = tier.pop(0)
            out.append((gap, serial, doc, start, ids[:gap]))
            self._route(doc, start + gap, ids[gap:])
            gap = 0
        return out

    def pack(self, last: bool = False) -> Iterator[list[Piece]]:
        for i in reversed(range(len(self.tiers))):
            size = self.tiers[i]
            # a window needs enough in its own and shorter tiers to be filled
            below = sum(p[0] for tier in self.waiting[: i + 1] for p in tier)
            own = self.waiting[i]
            while own and below >= size:
                piece = own.pop()
                seq = [piece, *self._fill_from(i, size - piece[0])]
                below -= size
                yield seq
        if last:
            left = sum(p[0] for tier in self.waiting for p in tier)
            for size in reversed(self.tiers):
                while left >= size:
                    left -= size
                    yield self._fill(size)
            if left:
                yield self._fill(left)
        self.held = sum(p[0] for tier in self.waiting for p in tier)

    def _fill_from(self, tier: int, gap: int) -> list[Piece]:
        """Fill from this tier and shorter ones only."""
        longer, self.waiting[tier + 1 :] = self.waiting[tier + 1 :], [[] for _ in self.waiting[tier + 1 :]]
        out = self._fill(gap)
        self.waiting[tier + 1 :] = longer
        return out


class Groups:
    """Deals full windows to step groups of equal tokens."""

    def __init__(self, size: int = STEP_TOKENS, open_: int = OPEN_GROUPS):
        self.size, self.next = size, open_
        self.open = [[0, i] for i in range(open_)]

    def place(self, tokens: int) -> int:
        fits = [g for g in self.open if g[0] + tokens <= self.size]
        if not fits:
            fits = [max(self.open)]
            fits[0][:] = [0, self.next]
            self.next += 1
        group = min(fits)
        group[0] += tokens
        number = group[1]
        if group[0] == self.size:
            group[:] = [0, self.next]
            self.next += 1
        return number


def powers_of_two(seq: list[Piece]) -> Iterator[list[Piece]]:
    """A sequence as sequences of ever smaller powers of two, cutting pieces where they end."""
    left = sum(p[0] for p in seq)
    pieces = list(reversed(seq))
    while left:
        size = gap = 1 << left.bit_length() - 1
        part = []
        while gap:
            n, serial, doc, start, ids = pieces.pop()
            take = min(n, gap)
            part.append((take, serial, doc, start, ids[:take]))
            if take < n:
                pieces.append((n - take, serial, doc, start + take, ids[take:]))
            gap -= take
        yield part
        left -= size


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 1, tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """A row per piece: where it comes from, its sequence, tier and step group, and its ids (4 bytes each, if asked for)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(lambda it: _pack(it, tokenizer, end_id, tiers, with_ids), SCHEMA)
    return packed if with_ids else packed.drop("ids")


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, tiers: tuple[int, ...], with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, packer, groups = encoder(tokenizer), Packer(tiers), Groups()
    base = TaskContext.get().partitionId() << 40
    serial, held, out = 0, 0, []
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def write(seq: list[Piece]) -> None:
        nonlocal serial, held
        size = sum(p[0] for p in seq)
        tier = next((t for t in packer.tiers if t == size), size)
        group, offset = base + groups.place(tier), 0
        for n, _, (doc_id, doc_tokens), start, ids in seq:
            raw = ids.astype("<u4").tobytes()
            out.append((doc_id, start, n, doc_tokens, base + serial, offset, tier, group, zlib.crc32(raw), raw if with_ids else None))
            offset += n
        serial += 1
        held += size

    def batch() -> pa.RecordBatch:
        nonlocal held
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        out.clear()
        held = 0
        return made

    for b in batches:
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
            ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
            for seq in packer.add((doc_id, len(ids)), ids):
                write(seq)
            if held >= POOL:
                yield batch()
    for seq in packer.pack(last=True):
        for part in [seq] if sum(p[0] for p in seq) in packer.tiers else powers_of_two(seq):
            write(part)
    if out:
        yield batch()
