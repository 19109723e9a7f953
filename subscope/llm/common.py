"""Shared pieces of the text operators: durable intermediate tables, Arrow
batches cut to a bounded number of bytes, and vectorised byte hashing.

Intermediate results that cut lineage are written as parquet below
``spark.checkpoint.dir`` (the shared folder the cluster names), so a lost
executor only costs the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# texts of one batch are worked on in slices of about this many bytes, which
# bounds the memory of the 8-byte-per-byte arrays of a Python worker
SLICE_BYTES = 1 << 21

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2^64
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session that names none
    (tests) gets a scratch folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="subscope-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a durable cut of
    the lineage that later jobs read as often as they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/subscope-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, text_col: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``max_bytes`` of text each
    (one longer text makes a slice of its own)."""
    n = batch.num_rows
    col = batch.column(batch.schema.get_field_index(text_col))
    if n == 0:
        return
    lengths = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def byte_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class SpanHash:
    """64-bit polynomial hashes of any spans of one byte array, each read off
    a running sum; equal spans hash equally wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * _BASE)


_CODES = np.arange(256)
# what makes a word: anything but ASCII white space; letters and digits
SOLID = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
ALNUM = (_CODES >= 128) | np.isin(_CODES, np.frombuffer(
    b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


def word_spans(data: np.ndarray, offsets: np.ndarray,
               kind: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a kind, never across two texts: (starts,
    ends, text index)."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = np.zeros(len(data) + 2, bool)
    if kind is SOLID:  # the same by two comparisons a byte
        np.logical_and(data != 32, data - np.uint8(9) > 4, out=solid[1:-1])
    else:
        solid[1:-1] = kind[data]
    edge = solid[1:] != solid[:-1]
    inner = offsets[1:-1]
    both = inner[solid[inner] & solid[inner + 1]]  # a word that touches the next text's first word
    bounds = np.flatnonzero(edge)
    if len(both):
        both = np.repeat(np.unique(both), 2)  # one ends and one starts there
        bounds = np.insert(bounds, np.searchsorted(bounds, both), both)
    starts, ends = bounds[0::2], bounds[1::2]
    return starts, ends, belongs(starts, offsets)


def belongs(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the part [offsets[i], offsets[i + 1]) of each of the ascending places."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(places, offsets)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, eight bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = (ends - starts).astype(np.uint64)
    h = size * _BASE
    left, at, which = size, starts, slice(None)
    while len(at):
        keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        h[which] = mix64(h[which] ^ (eight[at] & keep))
        more = np.flatnonzero(left > 8)
        which = more if isinstance(which, slice) else which[more]
        left, at = left[more] - np.uint64(8), at[more] + 8
    return h


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` consecutive words (given by their hashes)
    of one text, and the index of each run's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _BASE
        h += words[j: j + n]
    first = np.flatnonzero(text[:n] == text[k - 1:])
    return mix64(h[first] + np.uint64(k)), first


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)
