"""Removal of repeated passages on the phrases of a prefix-free parse.

Removed is every byte covered by a string of ``length`` (50) bytes that also
starts in a document with a smaller id; matches do not cross documents.

The parse: the rolling hash of each ``TRIGGER`` bytes is taken, and a place
where it is the least of some 50-byte window is a trigger. Every window has
exactly one trigger, which depends on its bytes alone, so equal windows are
cut alike wherever they stand. The windows of one trigger form a phrase: the
bytes from the first window's start to the last one's end.

1. Documents are written as blocks of compressed text. Each block gives its
   trigger hashes; a trigger that no other document has cannot be in a
   repeated window, and its phrase goes no further.
2. The phrases of the others form the dictionary: each block sends every
   distinct phrase once, with the smallest id that holds it.
3. Within a trigger, equal phrases are one; of different ones, the windows
   are grouped by their 64-bit hashes at the same place relative to the
   trigger, each with the smallest id. This stands in place of the suffix
   arrays of dictionary and parse: all matches asked for are of one fixed
   length, each lies in one phrase, and only the smallest id of equal windows
   is needed, for which their order is not.
4. Back in the blocks, a phrase that a smaller id has is covered as a whole;
   one that its document has first is covered where step 3 says so.

Only compressed blocks, hashes and the dictionary are shuffled, each a few
times; a passage that very many documents share is sent once by a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import SpanHash, byte_arrays, mix64, shuffle_partitions, stored, text_slices

LENGTH, TRIGGER = 50, 24
LONGEST = 86  # a phrase's windows are bits of one 64-bit number
BLOCK_BYTES = 1 << 21
SEGMENT = 1 << 20  # positions worked on at once
PART_TRIGGERS = 500_000  # triggers a reducer gets on average
NULL_ID = (1 << 63) - 1  # documents without id come last


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, sizes, payload): documents in blocks of compressed text."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for s in text_slices(batch, "text", BLOCK_BYTES):
                data, offsets = byte_arrays(s.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([s.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([np.diff(offsets).astype("<i8").tobytes()], pa.binary()),
                     pa.array([press.compress(data.tobytes())], pa.binary())],
                    names=["block", "ids", "sizes", "payload"])
                number += 1

    return base.mapInArrow(run, "block long, ids binary, sizes binary, payload binary")


class Block:
    """The phrases of a block: trigger hash, first window, windows, and the
    trigger's place in the first window."""

    def __init__(self, ids: bytes, sizes: bytes, payload: bytes, length: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.sizes = np.frombuffer(sizes, "<i8")
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        total = int(self.offsets[-1])
        raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(total, 1)) if total else b""
        self.data = np.frombuffer(raw, np.uint8)
        self.length = length
        parts = [self._segment(lo, min(lo + SEGMENT, total - length + 1))
                 for lo in range(0, max(0, total - length + 1), SEGMENT)]
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
        cols = [np.concatenate(c) for c in zip(empty, *parts)]
        self.trigger, self.phrase, self.start, self.windows, self.place, self.doc = cols

    def _segment(self, lo: int, hi: int):
        """Phrases of the windows that start in [lo, hi)."""
        length, w = self.length, min(TRIGGER, self.length)
        span = length - w + 1  # places of a trigger in a window
        data = self.data[lo: hi + length - 1]
        at = np.arange(len(data) - w + 1)
        hashes = SpanHash(data)
        h = hashes(at, at + w)
        low = (h & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)  # leftmost of equal ones
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width:])
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)  # of every window's trigger
        start = np.arange(hi - lo)
        doc = np.searchsorted(self.offsets, start + lo, side="right") - 1
        inside = start + lo + length <= self.offsets[doc + 1]
        start, place, doc = start[inside], place[inside], doc[inside]
        if not len(start):
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
        count = np.diff(np.r_[first, len(start)])
        a, m = start[first], place[first]
        phrase = mix64(hashes(a, a + count + length - 1) + (m - a).astype(np.uint64))
        return h[m], phrase, a + lo, count, m - a, doc[first]

    def shared_here(self) -> np.ndarray:
        """Phrases whose trigger stands in two or more documents of the block."""
        t, inverse = np.unique(self.trigger, return_inverse=True)
        low = np.full(len(t), np.iinfo(np.int64).max)
        high = np.full(len(t), -1)
        np.minimum.at(low, inverse, self.doc)
        np.maximum.at(high, inverse, self.doc)
        return (low < high)[inverse]

    def own(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the distinct shared phrases, each at its smallest id,
        and for every shared phrase the position of its own in that list."""
        which = np.flatnonzero(shared)
        order = which[np.lexsort((self.ids[self.doc[which]], self.phrase[which], self.trigger[which]))]
        t, p = self.trigger[order], self.phrase[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])][: len(order)]
        back = np.empty(len(order), np.int64)
        back[np.searchsorted(which, order)] = np.cumsum(new) - 1
        return order[new], back


def _part(trigger: np.ndarray, parts: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _split(part: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) runs of an order that is sorted by part."""
    if len(order):
        p = part[order]
        cut = np.flatnonzero(p[1:] != p[:-1]) + 1
        for run in np.split(order, cut):
            yield int(part[run[0]]), run


def _triggers(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, block, hashes): a block's distinct triggers, low 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t = np.unique(Block(r["ids"], r["sizes"], r["payload"], length).trigger)
                part = _part(t, parts)
                rows = [(p, t[i].astype(np.uint32).astype("<u4").tobytes())
                        for p, i in _split(part, np.argsort(part, kind="stable"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int32()), pa.array([r["block"]] * len(rows), pa.int64()),
                     pa.array([b for _, b in rows], pa.binary())], names=["part", "block", "hashes"])

    return blocks.mapInArrow(run, "part int, block long, hashes binary")


def _flag(table: pa.Table) -> pa.Table:
    """For every block, which of its triggers another block has (as bits)."""
    rows = [np.frombuffer(b, "<u4") for b in table.column("hashes").to_pylist()]
    size = [len(r) for r in rows]
    every = np.concatenate(rows)
    values, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    many = (count > 1)[inverse]
    bits = [np.packbits(x).tobytes() for x in np.split(many, np.cumsum(size)[:-1])]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})


def _shared(block: Block, flags: list[dict], parts: int) -> np.ndarray:
    """Which phrases have a trigger that another document may have."""
    t = np.unique(block.trigger)
    many = np.zeros(len(t), bool)
    bits = {f["part"]: f["bits"] for f in flags}
    part = _part(t, parts)
    for p, i in _split(part, np.argsort(part, kind="stable")):
        many[i] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=len(i)).astype(bool)
    return many[np.searchsorted(t, block.trigger)] | block.shared_here()


def _phrases(flagged: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, block, n, trigger, phrase, id, shape, text): the packed
    dictionary phrases of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["ids"], r["sizes"], r["payload"], length)
                own, _ = b.own(_shared(b, r["flags"], parts))
                part = _part(b.trigger[own], parts)
                out = []
                for p, i in _split(part, np.argsort(part, kind="stable")):
                    o = own[i]
                    size = b.windows[o] + length - 1
                    at = np.repeat(b.start[o] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    out.append((p, len(o), b.trigger[o].astype(np.uint32).astype("<u4").tobytes(),
                                b.phrase[o].astype("<u8").tobytes(), _planes(b.ids[b.doc[o]]),
                                np.column_stack([b.place[o], b.windows[o]]).astype("<u1").tobytes(),
                                press.compress(b.data[at].tobytes())))
                cols = list(zip(*out)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array([r["block"]] * len(out), pa.int64()),
                     pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                    names=["part", "block", "n", "trigger", "phrase", "id", "shape", "text"])

    return flagged.mapInArrow(
        run, "part int, block long, n long, trigger binary, phrase binary, id binary, shape binary, text binary")


def _planes(ids: np.ndarray) -> bytes:
    """Two bytes of all ids after the other: equal high bytes stand together."""
    return np.ascontiguousarray(ids.astype("<i8").view("<u2").reshape(len(ids), 4).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, "<u2").reshape(4, -1).T).view("<i8").ravel()


def _window_hashes(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of some phrases, a bounded number of bytes at a
    time; ``begin`` is where each phrase's bytes start."""
    size = windows + length - 1
    out, at = [np.zeros(0, np.uint64)], 0
    ends = np.cumsum(size)
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEGMENT, side="right")))
        own = size[at:to]
        first = np.cumsum(own) - own
        part = data[np.repeat(begin[at:to] - first, own) + np.arange(own.sum())]
        w = windows[at:to]
        start = np.repeat(first - (np.cumsum(w) - w), w) + np.arange(w.sum())
        out.append(SpanHash(part)(start, start + length))
        at = to
    return np.concatenate(out)


def _sorting(length: int):
    def order(table: pa.Table) -> pa.Table:
        def column(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        n = table.column("n").to_numpy()
        block_row = np.repeat(np.arange(len(n)), n)
        # of a trigger the part and 32 bits; two triggers that agree in both only share a group
        trigger, phrase = column("trigger", "<u4").astype(np.uint64), column("phrase", "<u8")
        ids = np.concatenate([_from_planes(b) for b in table.column("id").to_pylist()])
        place, windows = column("shape", "<u1").reshape(-1, 2).astype(np.int64).T
        un = zstandard.ZstdDecompressor()
        sizes = np.add.reduceat(windows + length - 1, np.cumsum(n) - n)
        data = np.frombuffer(b"".join(un.decompress(t, max_output_size=int(k)) for t, k in zip(
            table.column("text").to_pylist(), sizes)), np.uint8)
        begin = np.cumsum(windows + length - 1) - (windows + length - 1)
        by = np.lexsort((ids, phrase, trigger))
        t, p = trigger[by], phrase[by]
        new = np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])]
        group = np.empty(len(by), np.int64)  # the distinct phrase of every entry
        group[by] = np.cumsum(new) - 1
        rep = by[new]  # each distinct phrase at its smallest id
        # the windows of distinct phrases that share their trigger with others
        same = t[new][1:] == t[new][:-1]
        several = np.r_[False, same] | np.r_[same, False]
        r = rep[several]
        of = np.repeat(np.arange(len(r)), windows[r])
        j = np.arange(len(of)) - np.repeat(np.cumsum(windows[r]) - windows[r], windows[r])
        mask = np.zeros(len(rep), np.int64)
        if len(r):
            window = _window_hashes(data, begin[r], windows[r], length)
            key = mix64(window ^ mix64(trigger[r][of] + (place[r][of] - j).astype(np.uint64)))
            rank = np.lexsort((ids[r][of], key))
            k, d = key[rank], ids[r][of][rank]
            lead = np.r_[True, k[1:] != k[:-1]]
            least = d[np.maximum.accumulate(np.where(lead, np.arange(len(k)), 0))]
            covered = np.zeros(len(of), np.int64)
            covered[rank] = least < d
            some = np.zeros(len(r), np.int64)
            np.bitwise_or.at(some, of, covered << j)
            mask[several] = some
        first = ids[rep][group]
        # only what a block cannot know itself
        tell = np.flatnonzero((first < ids) | (mask[group] != 0))
        rows = block_row[tell]
        cut = np.flatnonzero(rows[1:] != rows[:-1]) + 1
        runs = np.split(tell, cut) if len(tell) else []
        blocks = table.column("block").to_numpy()
        return pa.table({
            "block": pa.array([int(blocks[block_row[x[0]]]) for x in runs], pa.int64()),
            "known": pa.array([np.column_stack([phrase[x].view(np.int64), first[x], mask[group[x]]])
                              .astype("<i8").tobytes() for x in runs], pa.binary())})

    return order


def _covered(b: Block, shared: np.ndarray, known: list[bytes]) -> np.ndarray:
    """Which bytes of a block are covered."""
    length = b.length
    own, back = b.own(shared)
    first, mask = b.ids[b.doc[own]].copy(), np.zeros(len(own), np.int64)
    if known:
        k = np.frombuffer(b"".join(known), "<i8").reshape(-1, 3)
        by = np.argsort(b.phrase[own])
        at = by[np.searchsorted(b.phrase[own][by], k[:, 0].copy().view(np.uint64))]
        first[at], mask[at] = k[:, 1], k[:, 2]
    which = np.flatnonzero(shared)
    ids = b.ids[b.doc[which]]
    full = (1 << b.windows[which]) - 1
    hit = np.where(ids > first[back], full, np.where(ids == first[back], mask[back], 0))
    change = np.zeros(len(b.data) + 1, np.int64)
    for j in range(int(b.windows.max()) if len(b.windows) else 0):
        at = b.start[which[(hit >> j) & 1 == 1]] + j
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): for every document the removed runs
    [(start, end) bytes) and the remaining bytes.

    A null text is empty; documents shorter than ``length`` lose nothing;
    rows that share an id do not affect each other, null ids come last.
    ``length`` is from TRIGGER to ``LONGEST``: a phrase keeps one bit a window
    in 64 bits."""
    if not TRIGGER <= length <= LONGEST:
        raise ValueError(f"length {length} is not from {TRIGGER} to {LONGEST}")
    blocks = stored(blocks_of(docs, id_col, text_col), "blocks")
    total = blocks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    parts = max(shuffle_partitions(docs), math.ceil(total * 2.5 * 2 / (length - TRIGGER + 2) / PART_TRIGGERS))
    flags = _triggers(blocks, parts, length).groupBy("part").applyInArrow(_flag, "block long, part int, bits binary")
    flags = stored(flags.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("flags")), "triggers")
    found = _phrases(blocks.join(flags, "block"), parts, length).groupBy("part").applyInArrow(
        _sorting(length), "block long, known binary")
    known = stored(found.groupBy("block").agg(F.collect_list("known").alias("known")), "phrases")
    out_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["ids"], r["sizes"], r["payload"], length)
                covered = _covered(b, _shared(b, r["flags"] or [], parts), r["known"] or [])
                spans, kept = [], []
                for lo, hi in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist()):
                    c = covered[lo:hi]
                    edge = np.flatnonzero(np.diff(np.r_[0, c.astype(np.int8), 0]))
                    spans.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
                    kept.append(b.data[lo:hi][~c].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids), pa.array(b.sizes), pa.array(spans, pa.list_(pa.struct(
                        [("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "spans", "kept"])

    done = blocks.join(flags, "block", "left").join(known, "block", "left").mapInArrow(
        run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return done.select(F.when(F.col("id") != NULL_ID, F.col("id")).cast(out_id).alias(id_col), "n_bytes", "spans", "kept")
