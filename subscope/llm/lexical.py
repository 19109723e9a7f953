"""Ranked lexical search over a length-stratified index.

The score of a document depends on its length through one small integer, the
normaliser ``m``, so the documents of equal ``m`` form a stratum in which a
posting's impact depends on the term and its count alone. The index has one
row for each block of a stratum: the document ids, and for each term the
groups of equal counts (ascending) with the documents in them. The impact of
a group is computed once. The last group of a term gives its greatest impact,
so the terms of an item bound its score in the block; blocks are visited by
descending bound, and an item skips those that cannot reach its best
``top`` so far.

The items are the query set, taken in blocks of a bounded size; an index
holds the postings of one block's vocabulary, of all documents. Documents
are read once, for their term counts; a stratum of any number of documents
is dealt over ranges of (m, row).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subscope.llm.common import ALNUM, byte_arrays, shuffle_partitions, stored, text_slices, word_hashes, word_spans

TOP = 20
ITEM_BYTES = 1 << 20  # of text (and 64 a row) in one block of items
PART_POSTINGS = 2_000_000  # of a range of the index on average
BLOCK_DOCS = 4096  # of a stratum in one row of the index
WINDOW_BYTES = 1 << 25  # of index rows whose visits are ordered together
PAIRS = 1 << 21  # postings times items added up at once
SCALE, SATURATION, NORM = 1_000_000_000, 1000, 12  # fixed values of the score

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
INDEX = "m long, docs array<bigint>, terms binary, counts binary, ends binary, members binary"


def _terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms (maximal runs of ASCII letters, digits and other
    code points from 128, A-Z lower-cased) and the texts they stand in."""
    data, offsets = byte_arrays(col)
    data = _LOWER[data]
    starts, ends, text = word_spans(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), text


class Items:
    """A block of items: the vocabulary, and which item has a term how often,
    sorted by term."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, item = _terms(pa.array(texts, pa.string()))
        self.ids = ids
        self.vocabulary, term = np.unique(h, return_inverse=True)
        key, self.times = np.unique(term * max(1, len(ids)) + item, return_counts=True)
        self.term, self.item = np.divmod(key, max(1, len(ids)))


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The items that have a term, in blocks dealt by row."""
    rows = stored(items.where(F.col(text_col).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).select(
        item_col, text_col, F.monotonically_increasing_id().alias("_row")), "search-items")
    size = rows.agg(F.sum(F.octet_length(text_col) + 64)).first()[0] or 0
    blocks = 1 + size // ITEM_BYTES
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b).collect()  # about ITEM_BYTES
        yield Items([r[0] for r in got], [r[1] for r in got])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrays of four-byte numbers, cut at ``ends``, as binaries."""
    offsets = (4 * np.r_[0, ends]).astype("<i4")
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])


def term_counts(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, counts, row): of every document with a term its number
    of terms, and the vocabulary's terms in it with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            for s in text_slices(batch, text_col):
                h, text = _terms(s.column(1))
                place = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                hit = words[place] == h if len(words) else np.zeros(len(h), bool)
                key, counts = np.unique(text[hit] * max(1, len(words)) + place[hit], return_counts=True)
                doc, term = np.divmod(key, max(1, len(words)))
                n = np.bincount(text, minlength=s.num_rows)
                ends = np.searchsorted(doc, np.arange(s.num_rows), side="right")
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).cast(pa.int64()), pa.array(n), _binary(term, ends), _binary(counts, ends)],
                    names=["doc", "n", "terms", "counts"]).filter(pa.array(n > 0))

    found = docs.select(id_col, text_col).mapInArrow(run, "doc long, n long, terms binary, counts binary")
    return stored(found.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "term-counts")


@dataclass
class Collection:
    """Statistics over all documents: with a term, terms in all, and the
    documents that hold each term of the vocabulary."""

    documents: int
    terms: int
    holders: np.ndarray
    postings: int

    def weights(self) -> np.ndarray:
        n = self.documents
        return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in self.holders], np.int64)


def collection(counted: DataFrame, size: int) -> Collection:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = byte_arrays(batch.column(0))
            held += np.bincount(np.frombuffer(data.tobytes(), "<u4"), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])

    got = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df")).toArrow()  # at most a row a term of the vocabulary
    holders = np.zeros(size, np.int64)
    holders[got["term"].to_numpy()] = got["df"].to_numpy()
    n, terms, postings = counted.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.octet_length("terms"))).first()
    return Collection(n, terms or 0, holders, (postings or 0) // 4)


def _numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4").astype(np.int64)


def build_index(counted: DataFrame, stats: Collection) -> DataFrame:
    """The index rows (``INDEX``): blocks of strata, documents of a block in
    order of id (nulls last)."""
    m = F.expr(f"75 + (25 * n * {stats.documents}L) div {max(1, stats.terms)}L")
    parts = max(shuffle_partitions(counted), math.ceil(stats.postings / PART_POSTINGS))
    dealt = counted.where("octet_length(terms) > 0").select(m.alias("m"), "doc", "terms", "counts", "row")
    dealt = dealt.repartitionByRange(parts, "m", "row").sortWithinPartitions("m").drop("row")

    def block(m: int, rows: pa.Table) -> list:
        ids = rows["doc"].combine_chunks()
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        rows = rows.take(pa.array(order))
        terms, counts = (_numbers(b"".join(rows[c].to_pylist())) for c in ("terms", "counts"))
        size = np.array([len(b) // 4 for b in rows["terms"].to_pylist()])
        member = np.repeat(np.arange(len(size)), size)
        by = np.lexsort((member, counts, terms))
        terms, counts, member = terms[by], counts[by], member[by]
        last = np.flatnonzero(np.r_[(terms[1:] != terms[:-1]) | (counts[1:] != counts[:-1]), True])
        return [m, rows["doc"].to_pylist(), *[x.astype("<u4").tobytes() for x in (
            terms[last], counts[last], last + 1, member)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now, size = None, 0

        def out() -> pa.RecordBatch:
            row = block(now, pa.concat_tables(held))
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)],
                                              names=["m", "docs", "terms", "counts", "ends", "members"])

        for batch in batches:
            ms = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.r_[True, ms[1:] != ms[:-1]][: len(ms)])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ms)]):
                for lo in range(a, b, BLOCK_DOCS):
                    more = pa.Table.from_batches([batch.slice(lo, min(b, lo + BLOCK_DOCS) - lo)])
                    if held and (now != ms[lo] or size + more.num_rows > BLOCK_DOCS):
                        yield out()
                        held, size = [], 0
                    held.append(more)
                    now, size = int(ms[lo]), size + more.num_rows
        if held:
            yield out()

    return stored(dealt.mapInArrow(run, INDEX), "strata")


class Block:
    """One row of the index with the impact of each group."""

    def __init__(self, m: int, docs: pa.Array, terms: bytes, counts: bytes, ends: bytes, members: bytes):
        self.docs, self.m = docs, m
        self.terms, counts, self.ends, self.members = map(_numbers, (terms, counts, ends, members))
        self.impact = SCALE * counts // (SATURATION * counts + NORM * m)  # once for each count of a term

    def best(self, size: int) -> np.ndarray:
        """The greatest impact of each term: that of its last group."""
        out = np.zeros(size, np.int64)
        out[self.terms] = self.impact  # groups of a term ascend, the last one stays
        return out


class Search:
    """The best documents of each item over the blocks visited so far."""

    def __init__(self, items: Items, weights: np.ndarray, top: int):
        self.top, self.size, self.n = top, len(items.vocabulary), len(items.ids)
        self.term, self.item, self.value = items.term, items.item, items.times * weights[items.term]
        self.least = np.ones(self.n, np.int64)  # scores below are out
        none = np.zeros(0, np.int64)
        self.found = (none, none, np.zeros(0, bool), none)  # item, id, id is null, score
        self.visited = self.skipped = 0

    def bounds(self, block: Block) -> np.ndarray:
        best = block.best(self.size)
        return _sums(self.item, self.value * best[self.term], self.n)

    def visit(self, block: Block, bounds: np.ndarray) -> None:
        active = bounds >= self.least
        self.visited += int(active.sum())
        self.skipped += int((~active).sum())
        if not active.any():
            return
        use = active[self.item]
        term, item, value = self.term[use], self.item[use], self.value[use]
        at = np.searchsorted(term, np.arange(self.size + 1))
        place = np.cumsum(active) - 1  # of the items that are scored
        docs = len(block.docs)
        group = np.repeat(np.arange(len(block.terms)), np.diff(np.r_[0, block.ends]))
        posted = block.terms[group]
        many = np.diff(at)[posted]
        scores = np.zeros(int(active.sum()) * docs, np.int64)
        ends = np.cumsum(many)
        lo = 0
        while lo < len(many):  # some postings at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            k = many[lo:hi]
            pair = np.repeat(at[posted[lo:hi]] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
            cell = place[item[pair]] * docs + np.repeat(block.members[lo:hi], k)
            scores += _sums(cell, value[pair] * np.repeat(block.impact[group[lo:hi]], k), len(scores))
            lo = hi
        self._take(block, np.flatnonzero(active), scores.reshape(-1, docs))

    def _take(self, block: Block, items: np.ndarray, scores: np.ndarray) -> None:
        docs = scores.shape[1]
        # documents are in order of id, so ties fall to the first ones
        key = scores * docs + np.arange(docs - 1, -1, -1)
        cut = np.partition(key, docs - self.top, axis=1)[:, docs - self.top][:, None] if docs > self.top else 0
        row, col = np.nonzero((key >= cut) & (scores >= self.least[items][:, None]))
        ids = block.docs.take(pa.array(col))
        new = (items[row], ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), scores[row, col])
        item, doc, null, score = (np.concatenate(x) for x in zip(self.found, new))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.n + 1))
        stays = np.arange(len(item)) - first[item] < self.top
        order, item = order[stays], item[stays]
        self.found = (item, doc[order], null[order], score[order])
        ends = np.searchsorted(item, np.arange(self.n), side="right")
        full = np.bincount(item, minlength=self.n) >= self.top
        self.least[full] = self.found[3][ends[full] - 1]


def _sums(place: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of 64-bit integers by place: ``bincount`` adds doubles,
    which are exact below 2^53, so large values go in two halves."""
    if not len(value) or int(value.max()) * len(value) < 1 << 53:
        return np.bincount(place, value, size).astype(np.int64)
    low, high = value & 0xFFFFFF, value >> 24
    return np.bincount(place, low, size).astype(np.int64) + (np.bincount(place, high, size).astype(np.int64) << 24)


def search_index(index: DataFrame, items: Items, weights: np.ndarray, top: int = TOP) -> DataFrame:
    """(item, doc, score): candidates for the best documents of each item,
    the ``top`` of every task."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, top)
        held: list[tuple[np.ndarray, Block]] = []
        size = 0

        def visit() -> None:
            for bounds, block in sorted(held, key=lambda x: -int(x[0].max(initial=0))):
                search.visit(block, bounds)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns[2:]]
                block = Block(batch.column(0)[i].as_py(), batch.column(1)[i].values, *row)
                held.append((search.bounds(block), block))
                size += sum(map(len, row))
                if size > WINDOW_BYTES:
                    visit()
                    size = 0
        visit()
        item, doc, null, score = search.found
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=null), pa.array(score, pa.int64())],
            names=["item", "doc", "score"])

    return index.mapInArrow(run, "item long, doc long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``top`` documents of each item by
    score above 0, equal scores by ascending id (nulls last).

    Repeated documents are ranked each; a repeated item row is answered each
    time. Null or termless documents and items are never matched and count
    in no statistic. Terms are compared by 64-bit hashes."""
    spark, out = docs.sparkSession, None
    kind = items.schema[item_col].dataType
    for block in item_blocks(items, item_col, item_text):
        counted = term_counts(docs, block.vocabulary, id_col, text_col)
        stats = collection(counted, len(block.vocabulary))
        index = build_index(counted, stats)
        found = search_index(index, block, stats.weights(), top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(
            list(enumerate(block.ids)), f"item long, `{item_col}` {kind.simpleString()}")  # one block of items
        best = best.join(F.broadcast(names), "item").select(
            item_col, "rank", F.col("doc").alias(id_col), "score")
        out = best if out is None else out.union(best)
    return out
