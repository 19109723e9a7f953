"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity, so
one MinHash setting cannot serve documents of all lengths. Documents are
partitioned by the number of their distinct word shingles (powers of two).
The signature of partition ``p`` is one-permutation MinHash with
``2^(p + 3)`` bins: at least eight bins for each shingle of the document.
The items are signed for every partition too, and each bin is a band: an item
is a candidate for a document if they agree in any bin. A shared shingle is
its bin's minimum in the document with a probability of at least 0.88, so an
item of eight shingles of which seven are shared is missed with a probability
below 1e-6; items of fewer than ``SHORT`` shingles are signed by all of them
and looked up in all of a document's shingles, which misses nothing. Every
candidate is verified by the exact share of the item's shingles that the
document holds.

The items are the query set. They are taken in blocks of a bounded number of
shingles, and each block is sent to all tasks, which read the documents in
place: no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import byte_arrays, lowered, shingle_hashes, text_slices, word_hashes, word_spans

K, LEAST = 5, 0.8
EXTRA_BITS = 3  # bins for each shingle, as a power of two
SHORT = 8
BLOCK_BYTES = 1 << 23  # item text that one block holds


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = byte_arrays(lowered(col))
    starts, ends, text = word_spans(data, offsets)
    return word_hashes(data, starts, ends), text


class ItemIndex:
    """The signatures of one block of items."""

    def __init__(self, ids: list, texts: list[str | None], k: int):
        h, text = _words(pa.array(texts, pa.string()))
        sizes = np.bincount(text, minlength=len(texts))
        self.ids, self.k = ids, k
        # an item shorter than a shingle is one shingle of its own length
        self.lengths = sorted({min(k, int(n)) for n in sizes if n})
        self.sets: list[np.ndarray] = []
        at = 0
        for n in sizes.tolist():
            own = h[at: at + n]
            at += n
            self.sets.append(np.unique(shingle_hashes(own, np.zeros(n, int), min(k, n))[0]) if n else own)
        self.length_of = [min(k, int(n)) for n in sizes]
        self._signed: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def signed(self, length: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted bin minima, item) of the items with shingles of that
        length, with the bins of a partition."""
        if (length, part) not in self._signed:
            values, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, s in enumerate(self.sets):
                if self.length_of[i] == length:
                    v = s if len(s) < SHORT else s[_first_of_bin(s, part)]
                    values.append(v)
                    items.append(np.full(len(v), i))
            v, i = np.concatenate(values), np.concatenate(items)
            order = np.argsort(v, kind="stable")
            self._signed[length, part] = v[order], i[order]
        return self._signed[length, part]

    def short(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted shingles, item) of the items looked up without bins."""
        pairs = sorted((int(x), i) for i, s in enumerate(self.sets)
                       if self.length_of[i] == length and 0 < len(s) < SHORT for x in s)
        return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)


def _first_of_bin(s: np.ndarray, part: int) -> np.ndarray:
    """Indices of each bin's minimum in sorted hashes; bins are ranges."""
    bins = s >> np.uint64(64 - min(63, part + EXTRA_BITS))
    first = np.ones(len(s), bool)
    first[1:] = bins[1:] != bins[:-1]
    return np.flatnonzero(first)


def _lookup(values: np.ndarray, keys: np.ndarray, items: np.ndarray) -> np.ndarray:
    lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
    hit = np.flatnonzero(hi > lo)
    return np.unique(np.concatenate([items[lo[i]: hi[i]] for i in hit])) if len(hit) else items[:0]


def _search(words: np.ndarray, text: np.ndarray, index: ItemIndex, least: float) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared shingles) of the texts of one slice."""
    for length in index.lengths:
        h, first = shingle_hashes(words, text, length)
        doc = text[first]
        order = np.argsort(h)
        order = order[np.argsort(doc[order], kind="stable")]
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        where = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
        short = index.short(length)
        for at, to in zip(where.tolist(), np.r_[where[1:], len(doc)].tolist()):
            own = h[at:to]
            part = max(0, int(to - at - 1).bit_length())
            found = _lookup(own[_first_of_bin(own, part)], *index.signed(length, part))
            if len(short[0]):
                found = np.union1d(found, _lookup(own, *short))
            for item in found.tolist():
                s = index.sets[item]
                place = np.searchsorted(own, s)
                shared = int((own[np.minimum(place, len(own) - 1)] == s).sum())
                if shared >= least * len(s) - 1e-9:
                    yield int(doc[at]), item, shared


def contained_items(docs: DataFrame, items: DataFrame, k: int = K, least: float = LEAST, id_col: str = "doc_id",
                    text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, shared, item_shingles, containment): every pair of a
    document and an item of which it holds at least ``least`` of the distinct
    word shingles (lower case, cut at ASCII white space).

    An item of fewer words than a shingle is one shingle of its own; items
    without words (or null) are never contained. Repeated documents and items
    give a pair each; null ids stay."""
    base = docs.select(id_col, text_col)
    schema = docs.select(id_col).schema.add(
        item_col, items.schema[item_col].dataType).add("shared", "long").add("item_shingles", "long")
    kind = pa.int64() if schema[item_col].dataType.typeName() == "long" else None
    out = None
    for sent in _sent(items, item_col, item_text):
        found = base.mapInArrow(_searcher(sent, k, least, id_col, text_col, item_col, kind), schema)
        out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def _sent(items: DataFrame, item_col: str, item_text: str) -> Iterator:
    """The items in blocks, each sent to all tasks."""
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_text), F.lit(blocks)) == b)
        rows = mine.select(item_col, item_text).collect()  # at most about BLOCK_BYTES of text
        yield items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


def without_items(docs: DataFrame, items: DataFrame, k: int = K, least: float = LEAST, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that :func:`contained_items` finds,
    dropped where they are read."""
    out = docs
    for sent in _sent(items, item_col, item_text):
        out = out.mapInArrow(_filter(sent, k, least, docs.columns.index(text_col), text_col), docs.schema)
    return out


def _filter(sent, k: int, least: float, at: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*sent.value, k)
        for batch in batches:
            for part in text_slices(batch, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, _, _ in _search(*_words(part.column(at)), index, least)]] = False
                yield part.filter(pa.array(keep))

    return run


def _searcher(sent, k: int, least: float, id_col: str, text_col: str, item_col: str, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*sent.value, k)
        for batch in batches:
            for part in text_slices(batch, text_col):
                hits = list(_search(*_words(part.column(1)), index, least))
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([d for d, _, _ in hits])),
                         pa.array([index.ids[i] for _, i, _ in hits], kind),
                         pa.array([s for _, _, s in hits], pa.int64()),
                         pa.array([len(index.sets[i]) for _, i, _ in hits], pa.int64())],
                        names=[id_col, item_col, "shared", "item_shingles"])

    return run
