"""Line dedup by an exact set-similarity join.

A line is the set of its words (cut at ASCII white space). A line is removed
if an earlier one, in order of document id and line number, has a Jaccard
similarity of at least ``percent`` / 100; all lines are compared as they came
in, whether or not they stay. Lines without words stay.

* Words are ordered by rarity: the class of a count of word hashes over all
  documents, then the hash. Two similar sets share a word among their rarest,
  so these prefixes meet by word; equal sets also meet by a hash of the set.
* Length, positional and bitmap filters (each a bound that no similar pair
  fails) leave the candidates.
* Candidates are verified by the exact Jaccard similarity of their words. A
  line needs one similar earlier line only, so its most promising candidate
  is verified first. Lines for which it fails and that had others go through
  further rounds, which list more candidates of these lines only.

Prefix entries travel as packed arrays, one row for each reducer and flush,
and of equal sets only the first of a flush does. The entries of one very
common word are cut into blocks, which meet by a join on their numbers and
are compared by tasks of their own. Text is moved only of
documents that may hold a candidate (a bitmap of fixed size tells).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import (
    byte_arrays,
    mix64,
    shuffle_partitions,
    stored,
    text_slices,
    word_hashes,
    word_spans,
)

PERCENT = 80
BUCKET_BITS = 17  # counters of word hashes
PART_ENTRIES = 150_000  # prefix entries a reducer gets on average
FLUSH_ENTRIES = 300_000
LISTED = 512  # candidates listed for an open line and word in the second round, then 8 times as many
BLOCK = 10_000  # entries of one word compared at once
NULL_ID = (1 << 63) - 1  # documents without id come last
FILTER_BITS = 21  # of the bitmap of documents or lines
WORD_FILTER_BITS = 24  # of the bitmap of words
PREFIX, HELD = 1, 2  # of a word: it is in the prefix of an open line, in one at all
EQUAL = -1  # the distance of a line that another one equals

_TOKEN = np.uint64((1 << 44) - 1)
ENTRY = np.dtype([("tok", "<u4"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("bits", "<u8"),
                  ("more_bits", "<u8")])
LINE = ["doc", "line", "bits"]
PAIR = "doc long, line int, bits long, cdoc long, cline int, cbits long, miss int, more boolean"
# a block of the entries of one common word: its number, least and greatest size of a set, packed entries
BLOCKS = "word long, number int, low int, high int, block binary"


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def overlap_needed(na, nb, percent: int):
    """Least number of shared words of similar sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_hashes(data, starts, ends) >> np.uint64(20)


def _packable(of: np.ndarray) -> bool:
    """Whether line numbers (ascending) fit above 44 bits of a word's hash."""
    return not len(of) or of[-1] < 1 << 20


class Lines:
    """The word sets of all lines of a slice, rows sorted by line; with
    ``words`` (``PREFIX`` and ``HELD`` by word) only those that may resemble
    an open line: a prefix word of one is among theirs, and of their words
    ``percent`` or more are of open lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: np.ndarray | None = None, percent: int = PERCENT):
        starts, ends, text = word_spans(data, offsets)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(starts, breaks)  # words before each break
        line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.r_[0, line, len(starts)])) + text
        new = np.r_[True, line[1:] != line[:-1]][: len(line)]
        of, tok = np.cumsum(new) - 1, _words(data, starts, ends)
        if words is not None and len(of):
            held = words[_word_hash(tok >> np.uint64(12))]
            use = (np.bitwise_or.reduceat(held, np.flatnonzero(new)) & PREFIX != 0)[of]
            line, text, new, tok = line[use], text[use], new[use], tok[use]
            of = np.cumsum(new) - 1
        if _packable(of):
            key = of.astype(np.uint64) << np.uint64(44) | tok
            key.sort()
            key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
            of, tok = (key >> np.uint64(44)).astype(np.int64), key & _TOKEN
        else:
            tok = tok[np.lexsort((tok, of))]
            once = np.r_[True, (of[1:] != of[:-1]) | (tok[1:] != tok[:-1])]
            of, tok = of[once], tok[once]
        if words is not None and len(of):
            held = np.bincount(of, words[_word_hash(tok >> np.uint64(12))] & HELD != 0)
            use = 100 * held >= percent * np.bincount(of)
            kept = use[of]
            tok, text, line = tok[kept], text[new][use], line[new][use]
            of, new = (np.cumsum(use) - 1)[of[kept]], slice(None)
        self.of, self.tok = of, tok
        self.at = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]][: len(self.of)])
        self.n = np.diff(np.r_[self.at, len(self.of)])
        self.text = text[new]
        first_line = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)
        self.line = line[new] - first_line[self.text]
        bit = np.uint64(1) << (self.tok & np.uint64(63))
        high = (self.tok >> np.uint64(6)) & np.uint64(1) == 1
        if len(self.tok):
            self.bits = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), self.at)
            self.more_bits = np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), self.at)
            self.sig = mix64(np.add.reduceat(mix64(self.tok), self.at) + self.n.astype(np.uint64))
        else:
            self.bits = self.more_bits = self.sig = self.tok


def _spans_of_lines(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, line: np.ndarray):
    """Where the given lines (text, number) start and end; numbers past the
    last line of a text give False in the third array."""
    breaks = np.flatnonzero(data == 10)
    first, last = np.searchsorted(breaks, offsets[text]), np.searchsorted(breaks, offsets[text + 1])
    at = first + line
    exists = at <= last
    padded = np.r_[breaks, len(data)]
    start = np.where(line == 0, offsets[text], padded[np.clip(at - 1, 0, len(breaks))] + 1)
    end = np.where(at < last, padded[np.clip(at, 0, len(breaks))], offsets[text + 1])
    return start, np.where(exists, end, start), exists


def some_lines(col: pa.Array, text: np.ndarray, line: np.ndarray) -> tuple[Lines, np.ndarray]:
    """The word sets of the given lines (text, number) alone, and which of
    the given lines each set belongs to (lines without words have none)."""
    data, offsets = byte_arrays(col)
    start, end, _ = _spans_of_lines(data, offsets, text, line)
    size = end - start
    own = np.r_[0, np.cumsum(size)]
    x = Lines(data[np.repeat(start - own[:-1], size) + np.arange(own[-1])], own)
    return x, x.text


def _wanted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, bits) of a column of array<struct<line, bits>>."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    return (lists.value_parent_indices().to_numpy(), flat.field(0).to_numpy().astype(np.int64),
            flat.field(1).to_numpy())


def _word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every bucket of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for s in text_slices(batch, "text"):
                data, offsets = byte_arrays(s.column(0))
                starts, ends, _ = word_spans(data, offsets)
                counts += np.bincount((_words(data, starts, ends) >> np.uint64(44 - BUCKET_BITS)).astype(np.int64),
                                      minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most 2^BUCKET_BITS rows
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _line_hash(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    x = mix64(doc.astype(np.int64).view(np.uint64) ^ mix64(line.astype(np.uint64) + np.uint64(1)))
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _word_hash(tok32: np.ndarray) -> np.ndarray:
    return (mix64(tok32.astype(np.uint64)) >> np.uint64(64 - WORD_FILTER_BITS)).astype(np.int64)


class Flush:
    """The lines and prefix entries of some slices, on their way out."""

    def __init__(self, parts: int):
        self.parts, self.lines, self.entries, self.n_lines, self.n_entries = parts, [], [], 0, 0

    def add(self, x: Lines, doc: np.ndarray, cls: np.ndarray, percent: int, words) -> None:
        key = (cls << np.uint64(39)) | (x.tok >> np.uint64(5))
        packable = _packable(x.of)
        if packable:
            key |= x.of.astype(np.uint64) << np.uint64(44)
        if words is not None:  # the words of open lines only
            wanted = words[_word_hash(x.tok >> np.uint64(12))] & PREFIX != 0
            order = np.argsort(key) if packable else np.lexsort((key, x.of))
            key, wanted = key[order], wanted[order]
        else:
            key = np.sort(key) if packable else key[np.lexsort((key, x.of))]
            wanted = True
        pos = np.arange(len(key)) - x.at[x.of]
        n = x.n[x.of]
        # sets this small have no similar set but equal ones
        use = (pos < n + percent * n // -100 + 1) & (n * (100 - percent) >= percent) & wanted
        self.lines.append((doc, x.line, x.n, x.bits, x.more_bits, x.sig))
        self.entries.append((x.of[use] + self.n_lines, mix64(key[use] & _TOKEN), pos[use]))
        self.n_lines += len(doc)
        self.n_entries += len(self.entries[-1][0])

    def rows(self, number: int, equal: bool) -> pa.RecordBatch:
        """Packed entries by part; with ``equal`` also an entry for every set
        and, packed in one of the rows, the lines that equal an earlier one
        of the flush."""
        doc, line, n, bits, more_bits, sig = map(np.concatenate, zip(*self.lines))
        of, tok, pos = map(np.concatenate, zip(*self.entries))
        order = np.lexsort((line, doc, sig))
        first = np.r_[True, sig[order][1:] != sig[order][:-1]]
        lead = np.repeat(order[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
        same = (doc[order] == doc[lead]) & (line[order] == line[lead])
        stays = np.zeros(len(doc), bool)
        stays[order[same]] = True
        use = stays[of]
        of, tok, pos = of[use], tok[use], pos[use]
        if equal:
            own = np.flatnonzero(stays)
            of, tok, pos = np.r_[of, own], np.r_[tok, sig[own]], np.r_[pos, np.full(len(own), EQUAL)]
        part = ((tok >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)
        by = np.argsort(part.astype(np.uint16) if self.parts < 1 << 16 else part, kind="stable")  # 16 bits: by radix
        of, tok, pos, part = of[by], tok[by], pos[by], part[by]
        e = np.empty(len(of), ENTRY)
        e["tok"], e["pos"], e["doc"], e["line"] = tok & np.uint64(0xFFFFFFFF), pos, doc[of], line[of]
        e["n"], e["bits"], e["more_bits"] = n[of], bits[of], more_bits[of]
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        out = [(int(part[a]), _pack(x), None) for a, x in zip(at, np.split(e, at[1:]))] if len(at) else []
        if equal and not stays.all():
            gone = np.empty((~stays).sum(), ENTRY[["doc", "line", "bits"]])
            gone["doc"], gone["line"], gone["bits"] = doc[~stays], line[~stays], bits[~stays]
            out.append((number % self.parts, None, _pack(gone)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()),
             pa.array([r[2] for r in out], pa.binary())], names=["part", "entries", "gone"])


def _entries(docs: DataFrame, rarity, parts: int, percent: int, words=None) -> DataFrame:
    """(part, entries, gone): see :class:`Flush`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, number = rarity.value, 0
        flush = Flush(parts)
        for batch in batches:
            for s in text_slices(batch, "text"):
                x = Lines(*byte_arrays(s.column(1)), None if words is None else words.value, percent)
                if len(x.tok):
                    cls = classes[(x.tok >> np.uint64(44 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
                    flush.add(x, s.column(0).to_numpy()[x.text], cls, percent, None if words is None else words.value)
                if flush.n_entries >= FLUSH_ENTRIES or flush.n_lines >= FLUSH_ENTRIES:
                    yield flush.rows(number, words is None)
                    flush, number = Flush(parts), number + 1
        if flush.n_lines:
            yield flush.rows(number, words is None)

    return docs.mapInArrow(run, "part int, entries binary, gone binary")


def _pack(e: np.ndarray) -> bytes:
    """Two bytes of one field after the other: equal high bytes of numbers
    stand together, which the shuffle's compression takes out."""
    return len(e).to_bytes(8, "little") + b"".join(
        np.ascontiguousarray(e[f]).view("<u2").reshape(len(e), -1).T.tobytes() for f in e.dtype.names)


def _unpack(b: bytes, kind: np.dtype = ENTRY) -> np.ndarray:
    n, at = int.from_bytes(b[:8], "little"), 8
    e = np.empty(n, kind)
    for f in e.dtype.names:
        size = e.dtype[f].itemsize
        planes = np.frombuffer(b, "<u2", n * size // 2, at).reshape(size // 2, n)
        e[f] = np.ascontiguousarray(planes.T).view(e.dtype[f]).ravel()
        at += n * size
    return e


class Found:
    """Earlier candidates of the wanted lines of some entries: of each the
    most promising one, or the ``listed`` most promising ones."""

    def __init__(self, e: np.ndarray, listed: int, wanted=None):
        self.e, self.listed = e, listed
        order = np.lexsort((e["line"], e["doc"]))
        d, i = e["doc"][order], e["line"][order]
        self.rank = np.empty(len(e), np.int64)  # of a line in the order of lines
        self.rank[order] = np.cumsum(np.r_[False, (d[1:] != d[:-1]) | (i[1:] != i[:-1])][: len(e)])
        self.wanted = None if wanted is None else wanted[_line_hash(e["doc"], e["line"], FILTER_BITS)]
        self.miss, self.best = np.full(len(e), 1 << 20), np.full(len(e), -1)
        self.more = np.zeros(len(e), bool)
        self.pairs: list[np.ndarray] = []
        self.count, self.full = 0, 1_000_000

    def add(self, a: np.ndarray, b: np.ndarray, miss: np.ndarray) -> None:
        """Pairs with each ``a`` once and each ``b`` once."""
        for late, early in ((a, b), (b, a)):
            use = self.rank[late] > self.rank[early]
            if self.wanted is not None:
                use &= self.wanted[late]
            at, to, m = late[use], early[use], miss[use]
            if self.listed > 1:
                self.pairs.append(np.column_stack([at, to, m]))
                self.count += len(at)
            else:
                self.more[at] |= self.best[at] >= 0
                better = m < self.miss[at]
                at, to, m = at[better], to[better], m[better]
                self.miss[at], self.best[at] = m, to
        if self.count > self.full:
            self._reduce()
            self.full = max(1_000_000, 2 * self.count)

    def _reduce(self) -> None:
        if not self.pairs:
            return
        f = np.concatenate(self.pairs)
        f = f[np.lexsort((self.rank[f[:, 1]], f[:, 2], f[:, 0]))]
        at = np.flatnonzero(np.r_[True, f[1:, 0] != f[:-1, 0]][: len(f)])
        place = np.arange(len(f)) - np.repeat(at, np.diff(np.r_[at, len(f)]))
        self.more[f[place >= self.listed, 0]] = True
        self.pairs = [f[place < self.listed]]
        self.count = len(self.pairs[0])

    def rows(self) -> list[np.ndarray]:
        if self.listed > 1:
            self._reduce()
            a, b, miss = (self.pairs[0] if self.pairs else np.zeros((0, 3), np.int64)).T
        else:  # one row for each line
            a = np.flatnonzero(self.best >= 0)
            a = a[np.lexsort((self.miss[a], self.e["bits"][a], self.rank[a]))]
            r, x = self.rank[a], self.e["bits"][a]
            new = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])][: len(a)]
            group = np.cumsum(new) - 1
            more = np.zeros(new.sum(), bool)
            np.logical_or.at(more, group, self.more[a] | (self.best[a] != self.best[a[new]][group]))
            a = a[new]
            self.more[a] = more
            b, miss = self.best[a], self.miss[a]
        e = self.e
        return [e["doc"][a], e["line"][a], e["bits"][a].view(np.int64), e["doc"][b], e["line"][b],
                e["bits"][b].view(np.int64), miss.astype(np.int32), self.more[a]]


class Fields:
    """The fields of entries that the filters read, each by itself."""

    def __init__(self, e: np.ndarray):
        self.n, self.rest = e["n"].astype(np.int64), (e["n"] - e["pos"]).astype(np.int64)
        self.bits, self.more_bits = np.ascontiguousarray(e["bits"]), np.ascontiguousarray(e["more_bits"])


def _passes(x: Fields, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (their places) pass the length, positional and bitmap
    filters, and their distance by the bitmaps, which are read last."""
    na, nb = x.n[a], x.n[b]
    ok = np.minimum(x.rest[a], x.rest[b]) * (100 + percent) >= percent * (na + nb)
    ok &= (percent * na <= 100 * nb) & (percent * nb <= 100 * na)
    at = np.flatnonzero(ok)
    a, b, both = a[at], b[at], (na + nb)[at]
    apart = np.bitwise_count(x.bits[a] ^ x.bits[b]).astype(np.int64) + np.bitwise_count(x.more_bits[a] ^ x.more_bits[b])
    near = (both - apart) // 2 * (100 + percent) >= percent * both
    return at[near], apart[near]


def _meet_sorted(e: np.ndarray, ends: np.ndarray, found: Found, percent: int) -> None:
    """Pairs of entries of one word each (sorted by word and size; ``ends``
    is where an entry's word ends), those ``d`` places apart at a time."""
    act, d = np.arange(len(e)), 1
    x = Fields(e)
    while True:
        act = act[act + d < ends[act]]
        act = act[percent * x.n[act + d] <= 100 * x.n[act]]
        if not len(act):
            return
        ok, apart = _passes(x, act, act + d, percent)
        found.add(act[ok], act[ok] + d, apart)
        d += 1


def _equal_lines(e: np.ndarray) -> np.ndarray:
    """The entries of sets that an earlier line equals."""
    same = ["tok", "n", "bits", "more_bits"]
    order = np.lexsort((e["line"], e["doc"], *[e[f] for f in same]))
    x = e[order]
    new = np.r_[True, np.any([x[f][1:] != x[f][:-1] for f in same], axis=0)][: len(x)]
    lead = x[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return x[(x["doc"] != lead["doc"]) | (x["line"] != lead["line"])]


def _meeting(percent: int, listed: int, wanted=None, block: int | None = None):
    block = block or BLOCK

    def meet(table: pa.Table) -> pa.Table:
        some = [_unpack(b) for b in table.column("entries").to_pylist() if b is not None]
        gone = [_unpack(b, ENTRY[LINE])[LINE] for b in table.column("gone").to_pylist() if b is not None]
        e = np.concatenate(some) if some else np.empty(0, ENTRY)
        del some
        gone.append(_equal_lines(e[e["pos"] == EQUAL])[LINE])
        gone = np.concatenate([np.rec.fromarrays([g[f] for f in LINE], names=LINE) for g in gone])
        e = e[e["pos"] != EQUAL]
        e = e[np.lexsort((e["n"], e["tok"]))]
        at = np.flatnonzero(np.r_[True, e["tok"][1:] != e["tok"][:-1]][: len(e)])
        size = np.diff(np.r_[at, len(e)])
        blocks = []
        for i in np.flatnonzero(size > 2 * block).tolist():  # a common word: blocks of similar length, each once
            own = e[at[i]: at[i] + size[i]]
            for j in range(0, len(own), block):
                x = own[j: j + block]
                blocks.append((int(x["tok"][0]), j // block, int(x["n"][0]), int(x["n"][-1]), _pack(x)))
        small = np.repeat(size <= 2 * block, size)
        e, ends = e[small], np.repeat(np.cumsum(np.where(size <= 2 * block, size, 0)), size)[small]
        found = Found(e, listed, None if wanted is None else wanted.value)
        _meet_sorted(e, ends, found, percent)
        return _table(found.rows(), blocks, gone)

    return meet


def _table(rows: list[np.ndarray], blocks: list[tuple] | None = None, gone=None) -> pa.Table:
    """A row a pair, then a row a line of ``gone``; with ``blocks`` (a list,
    of rows of ``BLOCKS``) a row each of these and their columns too."""
    names = [*LINE, "cdoc", "cline", "cbits", "miss", "more"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
    cols = [[pa.array(r, t)] for r, t in zip(rows, kinds)]
    n = len(rows[0])
    if gone is not None and len(gone):
        k = len(gone)
        extra = [gone["doc"], gone["line"], gone["bits"].view(np.int64), *[None] * 3, np.full(k, EQUAL, np.int32), None]
        for c, x, t in zip(cols, extra, kinds):
            c.append(pa.nulls(k, t) if x is None else pa.array(np.ascontiguousarray(x), t))
        n += k
    if blocks is None:
        return pa.table([pa.concat_arrays(c) for c in cols], names=names)
    own = [[None] * n + list(c) for c in (zip(*blocks) if blocks else [[]] * 5)]
    block_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    cols = [pa.concat_arrays([*c, pa.nulls(len(blocks), t)]) for c, t in zip(cols, kinds)]
    cols += [pa.array(c, t) for c, t in zip(own, block_kinds)]
    return pa.table(cols, names=[*names, "word", "number", "low", "high", "block"])


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """(x, y): the packed blocks of one word that can hold sets of similar
    sizes, each block with itself too. The pairs are made of the blocks'
    numbers and sizes alone; the entries join them by word and number, so no
    task holds more than it compares at a time."""
    size = blocks.select("word", "number", "low", "high")
    later = size.select("word", F.col("number").alias("other"), F.col("low").alias("other_low"))
    pairs = size.join(later, "word").where(
        (F.col("number") <= F.col("other")) & (percent * F.col("other_low") <= 100 * F.col("high")))
    x = blocks.select("word", "number", F.col("block").alias("x"))
    y = blocks.select("word", F.col("number").alias("other"), F.col("block").alias("y"))
    return pairs.select("word", "number", "other").join(x, ["word", "number"]).join(y, ["word", "other"]).select("x", "y")


def _compare_blocks(pairs: DataFrame, percent: int, listed: int, wanted=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = _unpack(left.as_py()), _unpack(right.as_py())
                same = left.equals(right)
                e = x if same else np.concatenate([x, y])
                found = Found(e, listed, None if wanted is None else wanted.value)
                if same:
                    _meet_sorted(e, np.full(len(e), len(e)), found, percent)
                else:
                    left, right, fields = np.arange(len(x)), np.arange(len(y)), Fields(e)
                    for shift in range(max(len(x), len(y))):  # every pair once, no entry twice at a time
                        if len(x) <= len(y):
                            a, c = left, len(x) + (left + shift) % len(y)
                        else:
                            a, c = (right + shift) % len(x), len(x) + right
                        ok, apart = _passes(fields, a, c, percent)
                        found.add(a[ok], c[ok], apart)
                yield from _table(found.rows()).to_batches()

    return pairs.mapInArrow(run, PAIR)


def _bitmap(rows: DataFrame, bits: int, places) -> np.ndarray:
    """Which of the ``2^bits`` places that a function gives for the columns of
    a batch occur: set in Spark, collected as at most ``2^bits / 64`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(places(batch))
            word, at = np.unique(h >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.int64(1) << (h & 63), at) if len(h) else h
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value)], names=["w", "b"])

    got = rows.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _line_places(batch: pa.RecordBatch) -> np.ndarray:
    return _line_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy(), FILTER_BITS)


def _word_places(batch: pa.RecordBatch) -> np.ndarray:
    data, _ = byte_arrays(batch.column(0))
    return _word_hash(np.frombuffer(data.tobytes(), "<u4"))


def _prefix_places(rarity, percent: int):
    """Places of the prefix words of the sets in a batch: similar sets share
    a word of both their prefixes, so no other word of an open line matters."""

    def places(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = byte_arrays(batch.column(0))
        tok, ends = np.frombuffer(data.tobytes(), "<u4"), offsets // 4
        n = np.diff(ends)
        row = np.repeat(np.arange(len(n)), n)
        key = rarity.value[tok >> np.uint32(32 - BUCKET_BITS)].astype(np.uint64) << np.uint64(32) | tok
        order = np.lexsort((key, row))
        key = key[order]
        pos = np.arange(len(key)) - np.repeat(ends[:-1], n)
        size = n + percent * n // -100 + 1  # of the prefix
        # the rest of a word's hash decides between equal keys: take them all
        edge = key[(ends[:-1] + np.minimum(size, n) - 1)[row]] if len(key) else key
        return _word_hash(tok[order][(pos < size[row]) | (key <= edge)])

    return places


def _doc_place() -> Column:
    return F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))


def maybe_in(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (with a column ``doc``) that may be, and that surely are not,
    among the ids ``doc``: a test of one bit of a bitmap of fixed size."""
    h = ids.select(_doc_place().alias("h"))
    words = stored(h.groupBy(F.shiftright("h", 6).alias("_doc_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("_doc_bits")), "doc-bitmap")
    # at most 2^FILTER_BITS / 64 = 32768 rows of 16 bytes: the bound of the broadcast
    j = docs.withColumn("_doc_word", F.shiftright(_doc_place(), 6)).join(F.broadcast(words), "_doc_word", "left")
    hit = F.coalesce(F.getbit("_doc_bits", (_doc_place() % 64).cast("int")) == 1, F.lit(False))
    return tuple(j.where(x).select(*docs.columns) for x in (hit, ~hit))


def _word_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, line, bits, toks): the words of the wanted lines."""
    per = wanted.groupBy("doc").agg(F.collect_set(F.struct("line", "bits")).alias("want"))  # lines of one document
    near, _ = maybe_in(docs, wanted.select("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch, "text"):
                text, line, want = _wanted(s.column(2))
                x, of = some_lines(s.column(1), text, line)
                use = np.flatnonzero(x.bits.view(np.int64) == want[of])
                ends = np.r_[x.at[1:], len(x.tok)]
                short = (x.tok >> np.uint64(12)).astype("<u4")
                toks = [short[x.at[i]: ends[i]].tobytes() for i in use.tolist()]
                of = of[use]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(text[of])), pa.array(line[of], pa.int32()), pa.array(want[of], pa.int64()),
                     pa.array(toks, pa.binary())], names=["doc", "line", "bits", "toks"])

    sets = near.join(per, "doc").select("doc", "text", "want").mapInArrow(
        run, "doc long, line int, bits long, toks binary")
    return sets.dropDuplicates(["doc", "line", "bits"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose word sets are similar enough."""
    other = sets.select(F.col("doc").alias("cdoc"), F.col("line").alias("cline"), F.col("bits").alias("cbits"),
                        F.col("toks").alias("ctoks"))
    j = pairs.select("doc", "line", "bits", "cdoc", "cline", "cbits").join(sets, ["doc", "line", "bits"]).join(
        other, ["cdoc", "cline", "cbits"]).select("doc", "line", "bits", "toks", "ctoks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                sides = []
                for c in (3, 4):
                    data, offsets = byte_arrays(b.column(c))
                    toks = np.frombuffer(data.tobytes(), "<u4").astype(np.uint64)
                    n = np.diff(offsets) // 4
                    sides.append((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32) | toks, n))
                both = np.sort(np.concatenate([sides[0][0], sides[1][0]]))
                twice = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
                shared = np.bincount(twice.astype(np.int64), minlength=b.num_rows)
                ok = 100 * shared >= percent * (sides[0][1] + sides[1][1] - shared)
                yield b.select(["doc", "line", "bits"]).filter(pa.array(ok))

    return j.mapInArrow(run, "doc long, line int, bits long").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                  listed: int = LISTED) -> DataFrame:
    """(doc, line, bits): every line that an earlier one makes redundant.
    ``doc`` is the id (null ids: ``NULL_ID``), ``line`` counts from 0, and
    ``bits`` tells lines of documents that share an id apart; lines with the
    same id and number do not remove each other."""
    context = docs.sparkSession.sparkContext
    base = docs.select(_key(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = _word_counts(base)
    rarity = context.broadcast(np.minimum(31, np.log2(np.maximum(counts, 1))).astype(np.uint8))
    parts = max(shuffle_partitions(docs), math.ceil(int(counts.sum()) * (100 - percent) / 100 / PART_ENTRIES))

    def candidates(listed: int, wanted=None, words=None) -> DataFrame:
        met = _entries(base, rarity, parts, percent, words).groupBy("part").applyInArrow(
            _meeting(percent, listed, wanted), f"{PAIR}, {BLOCKS}")
        met = stored(met, "line-pairs")
        pairs = met.where("word IS NULL").drop("word", "number", "low", "high", "block")
        blocks = met.where("word IS NOT NULL").select("word", "number", "low", "high", "block")
        if blocks.isEmpty():
            return pairs
        return pairs.union(_compare_blocks(_block_pairs(blocks, percent).repartition(parts), percent, listed, wanted))

    pairs = candidates(1)
    best = stored(pairs.groupBy(*LINE).agg(
        F.min(F.struct("miss", "cdoc", "cline", "cbits")).alias("b"),
        (F.max("more") | F.coalesce(
            F.min(F.struct("cdoc", "cline", "cbits")) != F.max(F.struct("cdoc", "cline", "cbits")), F.lit(False))
         ).alias("more")), "line-candidates")
    removed = best.where(F.col("b.miss") == EQUAL).select(*LINE)
    best = best.where(F.col("b.miss") != EQUAL).select(*LINE, "b.cdoc", "b.cline", "b.cbits", "more")
    sets = stored(_word_sets(base, best.select(*LINE).union(best.select("cdoc", "cline", "cbits"))), "word-sets")
    hit = stored(_verified(best, sets, percent), "similar-lines")
    removed = removed.union(hit)
    left = stored(best.where("more").select(*LINE).join(hit, LINE, "left_anti"), "open-lines")
    while not left.isEmpty():
        wanted = context.broadcast(_bitmap(left.select("doc", "line"), FILTER_BITS, _line_places))  # 2 MB
        open_sets = stored(sets.join(left, LINE, "left_semi").select("toks"), "open-sets")
        prefix, held = (_bitmap(open_sets, WORD_FILTER_BITS, f) for f in (_prefix_places(rarity, percent), _word_places))
        words = context.broadcast(prefix * np.uint8(PREFIX) | held * np.uint8(HELD))  # 16 MB
        pairs = candidates(listed, wanted, words).join(left, LINE, "left_semi")
        pairs = stored(pairs.groupBy(*LINE, "cdoc", "cline", "cbits").agg(F.max("more").alias("more")), "line-candidates")
        sets = stored(_word_sets(base, pairs.select(*LINE).union(pairs.select("cdoc", "cline", "cbits"))), "word-sets")
        hit = stored(_verified(pairs, sets, percent), "similar-lines")
        removed = removed.union(hit)
        left = stored(pairs.where("more").select(*LINE).distinct().join(hit, LINE, "left_anti"), "open-lines")
        listed *= 8
    return stored(removed.distinct(), "removed-lines")


def _per_document(removed: DataFrame) -> DataFrame:
    return removed.groupBy("doc").agg(F.collect_set(F.struct("line", "bits")).alias("gone"))  # lines of one document


def _cut(docs: DataFrame, id_col: str, text_col: str, removed: DataFrame) -> DataFrame:
    """``docs`` with their text without the removed lines, and the columns
    ``n_lines`` and ``lines_removed`` (their numbers)."""
    base = docs.withColumn("doc", _key(id_col)).withColumn("n_lines", F.when(
        F.col(text_col).isNull(), 0).otherwise(
            1 + F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))).cast("long"))
    hit, clean = maybe_in(base, removed.select("doc"))
    joined = hit.join(_per_document(removed), "doc", "left")
    at, gone_at = joined.columns.index(text_col), joined.columns.index("gone")
    names = [c for c in joined.columns if c != "gone"] + ["lines_removed"]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("gone").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in text_slices(batch, text_col):
                text, line, want = _wanted(s.column(gone_at))
                x, of = some_lines(s.column(at), text, line)
                of = of[x.bits.view(np.int64) == want[of]]
                of = of[np.lexsort((line[of], text[of]))]
                lines = np.split(line[of], np.searchsorted(text[of], np.arange(1, s.num_rows)))
                numbers = [c.tolist() for c in lines]
                texts = s.column(at).to_pylist()
                for t, cut in enumerate(numbers):
                    if cut:
                        gone = set(cut)
                        texts[t] = "\n".join(y for i, y in enumerate(texts[t].split("\n")) if i not in gone)
                cols = list(s.columns)
                cols[at] = pa.array(texts, pa.string())
                cols.pop(gone_at)
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(numbers, pa.list_(pa.int32()))], names=names)

    done = joined.mapInArrow(run, f"{out_schema}, lines_removed array<int>")
    clean = clean.withColumn("lines_removed", F.array().cast("array<int>"))
    return done.select(*clean.columns).union(clean).drop("doc")


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (columns named doc, n_lines, lines_removed or gone apart) with
    redundant lines cut out of the text, and ``n_lines`` and
    ``lines_removed``. Documents stay, even with nothing left; null texts
    stay null; repeated rows and null ids stay."""
    own = docs.drop("doc", "n_lines", "lines_removed", "gone", "_h")
    return _cut(own, id_col, text_col, removed_lines(own, percent, id_col, text_col))
