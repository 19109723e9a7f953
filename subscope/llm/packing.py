"""Packing by concatenate and cut.

All token ids, each document's followed by the end id, form one stream in the
stable order of a written table; windows of ``length`` ids cut it into
sequences. Offsets come from a two-pass prefix sum: tasks count while they
tokenize (a running sum within the partition), the partition totals (one row
per task) are summed up in order, and every document adds its partition's
offset to its own. A document that crosses a window border gives one piece
for each window, so only the last sequence is short.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subscope.llm.common import stored

CACHE_WORDS = 300_000  # words whose ids a Python worker keeps
OUT_BYTES = 1 << 24


class Encoder:
    """Ids of the byte-level BPE vocabulary as little-endian uint16 bytes.

    Equal to ``tokenizers.Tokenizer.from_file(json).encode(text,
    add_special_tokens=False)``. A word with the space before it is always
    encoded alone by this vocabulary's splitting pattern, so the ids of words
    are kept; new words are encoded by tiktoken with the same vocabulary.
    Texts that hold the vocabulary's special token go to ``tokenizers``.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json = public_tokenizers.path(f"{name}.json")
        self._whole = None
        self._ids: dict[str, bytes] = {}
        # a space that does not start a word: before white space, or at the end
        self._odd = re.compile(r" (?=\s|$)")

    def _plain(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self._json)
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if self._odd.search(text):
            return self._plain(text)
        known = self._ids
        if len(known) > CACHE_WORDS:
            known.clear()
        first, *words = text.split(" ")
        out = [self._plain(first)]
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._plain(" " + w)
                if len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


def tokenized(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end_id: int = 1, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(id, part, before, n, ids): every document's ids with the end id
    (little-endian uint16), and how many ids precede it in its partition."""
    schema = docs.select(id_col).schema.add("part", "integer").add("before", "long").add("n", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            keep, ids, starts, counts, held = [], [], [], [], 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                one = encode(texts[i].as_py() or "") + end
                keep.append(i)
                ids.append(one)
                starts.append(before)
                counts.append(len(one) // 2)
                before += counts[-1]
                held += len(one)
                if held > OUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(keep)), pa.array([part] * len(keep), pa.int32()),
                         pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                        schema=pa.schema([pa.field(id_col, batch.column(0).type), ("part", pa.int32()),
                                          ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]))
                    keep, ids, starts, counts, held = [], [], [], [], 0

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pieces_of(tokens: DataFrame, length: int, id_col: str = "doc_id") -> DataFrame:
    """Cut the stream of a written token table into pieces."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per task of the tokenizing stage, whatever the corpus: this is
    # the bound of the one-partition window and of the broadcast
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))
    placed = tokens.join(F.broadcast(offsets), "part").select(
        F.col(id_col), (F.col("offset") + F.col("before")).alias("at"), "ids")
    schema = tokens.select(id_col).schema
    for c, t in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"),
                 ("sequence_id", "long"), ("offset", "long"), ("ids", "binary")):
        schema = schema.add(c, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy()
            for lo in range(0, batch.num_rows, 1 << 11):
                yield cut(batch.slice(lo, 1 << 11), at[lo: lo + (1 << 11)])

    def cut(batch: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        row, start, size, crc, total, seq, off, out = [], [], [], [], [], [], [], []
        for i, (first, ids) in enumerate(zip(at.tolist(), batch.column(2).to_pylist())):
            n, s = len(ids) // 2, 0
            while s < n:
                o = (first + s) % length
                k = min(n - s, length - o)
                piece = ids[2 * s: 2 * (s + k)]
                row.append(i)
                start.append(s)
                size.append(k)
                crc.append(zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4")))
                total.append(n)
                seq.append((first + s) // length)
                off.append(o)
                out.append(piece)
                s += k
        longs = [pa.array(x, pa.int64()) for x in (start, size, crc, total, seq, off)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), *longs, pa.array(out, pa.binary())],
            names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(run, schema)


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start (the document's ids before it), length,
    ids_crc32 (of its ids as little-endian uint32), doc_tokens (with the end
    id), sequence_id, offset in the sequence, ids (little-endian uint16).

    A null or empty text is just the end id; repeated rows and null ids are
    documents of their own; an empty table gives no piece.
    """
    tokens = stored(tokenized(docs, vocabulary, end_id, id_col, text_col), "tokens")
    return pieces_of(tokens, length, id_col)
