"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most ``2 r`` bits apart have a value half way
between them that is at most ``r`` bits from each. So every distinct
fingerprint emits its whole ball of radius ``r`` (all values at most ``r``
bits away), equal values meet, and fingerprints that meet are linked.

The ball is emitted in two steps to keep the shuffle small. Before it, a
fingerprint is sent once to each value that ``b`` chosen bits can take in its
ball. After it, the group of one such value completes the variants in the
other bits. Every variant is made exactly once and meets all its equals.
``b`` follows from the number of distinct fingerprints, so that a group makes
about the same number of variants at every size. A group that is larger still
(many fingerprints around one centre) is emitted again on the next ``b``
bits, until it is small or all 64 bits are fixed.

A group returns a spanning forest of its links (at most one row per
fingerprint), so dense groups never give all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import stored, text_slices
from subscope.llm.components import connected_components

SEED = 42
GROUP_VARIANTS = 1 << 21  # variants a group makes on average
CHUNK_VARIANTS = 1 << 22  # variants a task holds at once
HOT_ROWS = 1 << 16  # a larger group is emitted again on further bits


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of one text; see :func:`fingerprints`."""
    return int(_fingerprints([text], shingle)[0])


def _shingle_hashes(text: str | None, shingle: int) -> list[int]:
    if not text:
        return []
    # bytes.lower() changes A-Z only; bytes.split() cuts at exactly \x20 and \x09-\x0d
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[shingle - 1:].tolist()
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends)]


def _fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = _shingle_hashes(text, shingle)
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):  # 1 MB of bits at a time
            part = np.array(hashes[at: at + (1 << 14)], dtype="<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        out[i] = place[2 * votes > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, fp): A-Z lower-cased, words cut at ASCII white space, word
    shingles with repeats hashed by XXH64 (seed 42); a bit is set if it is
    set in over half the hashes. Fewer words than a shingle: the whole
    sequence is one shingle; none, or a null text: 0."""
    schema, n = docs.select(*keep).schema.add("fp", "long"), len(keep)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                fps = _fingerprints(part.column(n).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(fps.view(np.int64))], names=names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def flips(bits: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of at most ``most`` of the given bits, and their counts."""
    masks = [(sum(1 << b for b in c), k) for k in range(most + 1) for c in combinations(bits, k)]
    return np.array([m for m, _ in masks], np.uint64), np.array([k for _, k in masks], np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, a, root[b])
        root = root[root]
        keep = root[a] != root[b]
        low, high = np.minimum(root[a], root[b])[keep], np.maximum(root[a], root[b])[keep]
        np.minimum.at(root, high, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        a, b = a[keep], b[keep]
    return root


def _meet(fps: np.ndarray, prefix: int, fixed: int, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group: all variants of ``fps`` whose ``fixed`` lowest
    bits equal ``prefix``, in slices of a bounded number of variants."""
    fps = np.unique(fps)
    low = np.uint64((1 << fixed) - 1)
    base = (fps & ~low) | np.uint64(prefix)
    left = radius - np.bitwise_count((fps ^ np.uint64(prefix)) & low).astype(np.int64)
    masks, cost = flips(list(range(fixed, 64)), radius)
    reach = np.array([(cost <= k).sum() for k in range(radius + 1)])
    total = int(reach[left].sum())
    slices = max(1, math.ceil(total / CHUNK_VARIANTS))
    a_all, b_all = [], []
    for s in range(slices):
        values, owners = [], []
        for k in range(radius + 1):
            own = np.flatnonzero(left == k)
            step = max(1, (1 << 20) // int(reach[k]))
            for at in range(0, len(own), step):
                o = own[at: at + step]
                v = (base[o][:, None] ^ masks[: reach[k]][None, :]).ravel()
                w = np.repeat(o, reach[k]).astype(np.int32)
                if slices > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == np.uint64(s)
                    v, w = v[mine], w[mine]
                values.append(v)
                owners.append(w)
        v, w = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v)
        v, w = v[order], w[order]
        same = np.flatnonzero(v[1:] == v[:-1]) + 1
        if not len(same):
            continue
        first = np.arange(len(v))
        first[same] = 0
        first = np.maximum.accumulate(first)
        a, b = w[first[same]].astype(np.int64), w[same].astype(np.int64)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= distance  # verify
        pair = np.unique(a[near] * len(fps) + b[near])
        a_all.append(pair // len(fps))
        b_all.append(pair % len(fps))
    if not a_all:
        return fps[:0], fps[:0]
    root = _forest(len(fps), np.concatenate(a_all), np.concatenate(b_all))
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[member]], fps[member]


def _meeting(fixed: int, radius: int, distance: int):
    def meet(table: pa.Table) -> pa.Table:
        prefix = table.column("prefix")[0].as_py() & ((1 << 64) - 1)
        fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = _meet(fps, prefix, fixed, radius, distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return meet


def near_links(distinct: DataFrame, count: int, distance: int = 4, hot_rows: int = HOT_ROWS,
               group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints joined by chains
    of steps of at most ``distance`` (even) bits. ``distinct`` has distinct
    fingerprints ``fp``; ``count`` is their number."""
    if distance % 2 or distance < 0:
        raise ValueError("the distance must be even, so that a value half way exists")
    radius = distance // 2
    ball = len(flips(list(range(64)), radius)[0])
    step = min(20, max(4, math.ceil(math.log2(max(2, count * ball / group_variants)))))
    rows = distinct.select(F.lit(0).cast("long").alias("prefix"), "fp")
    links, fixed = [], 0
    while True:
        to = min(64, fixed + step)
        masks, _ = flips(list(range(fixed, to)), radius)

        def spread(batches: Iterator[pa.RecordBatch], fixed=fixed, to=to, masks=masks) -> Iterator[pa.RecordBatch]:
            low = np.uint64((1 << fixed) - 1)
            block = np.uint64((1 << to) - 1) ^ low
            for batch in batches:
                pre = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
                fp = batch.column(1).to_numpy().astype(np.int64).view(np.uint64)
                for at in range(0, len(fp), 1 << 12):
                    p, f = pre[at: at + (1 << 12)], fp[at: at + (1 << 12)]
                    new = (p | (f & block))[:, None] ^ masks[None, :]
                    spent = np.bitwise_count((new ^ f[:, None]) & (low | block))
                    i, j = np.nonzero(spent <= radius)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(new[i, j].view(np.int64)), pa.array(f[i].view(np.int64))], names=["prefix", "fp"])

        spreaded = rows.mapInArrow(spread, "prefix long, fp long")
        if to == 64:  # whole variants: equal prefixes meet, the smallest owner is the centre
            centre = spreaded.groupBy("prefix").agg(F.min("fp").alias("a"))
            links.append(spreaded.join(centre, "prefix").where("a <> fp").select("a", F.col("fp").alias("b"))
                         .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct())
            break
        hot = stored(spreaded.groupBy("prefix").count().where(F.col("count") > hot_rows).select("prefix"), "hot")
        some = not hot.isEmpty()
        cold = spreaded.join(hot, "prefix", "left_anti") if some else spreaded

        links.append(cold.groupBy("prefix").applyInArrow(_meeting(to, radius, distance), "a long, b long"))
        if not some:
            break
        rows, fixed = stored(spreaded.join(hot, "prefix", "left_semi"), "hot-rows"), to
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def components(fps: DataFrame, distance: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``fps`` (id,
    fp): the smallest fingerprint and the smallest id (nulls last) reachable
    over links of at most ``distance`` bits."""
    classes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    links = near_links(classes.select("fp"), classes.count(), distance)
    linked = connected_components(links).withColumnRenamed("node", "fp").join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.select("fp", "root").join(least, "root")
    return classes.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(
            F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): every document with its fingerprint and the
    smallest id (nulls last) reachable over links of at most ``distance``
    bits, its own included. Documents without words have fingerprint 0 and
    are linked like any other; repeated rows stay."""
    fps = stored(fingerprints(docs, shingle, text_col, (id_col,)), "simhash")
    # written first: a join of two plain exchanges, in which Spark splits a very common fingerprint
    of = stored(components(fps, distance, id_col).select("fp", "component_id"), "simhash-components")
    return fps.join(of, "fp").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One document of each group of linked ones, with all its columns: the
    one of the smallest id (nulls last; of repeated ids, that of the smallest
    fingerprint; of repeated rows, any)."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # no clash with the columns made here
    own, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    rows = stored(fingerprints(plain, shingle, text, tuple(plain.columns)), "simhash-rows")
    fps = rows.select(F.col(own).alias("id"), "fp")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    best = fps.groupBy("fp").agg(F.min(order).alias("o"))  # one row a fingerprint meets the components
    chosen = best.join(components(fps, distance, "id"), "fp").groupBy("root").agg(F.min("o").alias("o"))
    chosen = chosen.select(F.col("o.id").alias("id"), F.col("o.fp").alias("fp"))
    kept = rows.join(chosen, (rows["fp"] == chosen["fp"]) & rows[own].eqNullSafe(chosen["id"]), "left_semi")
    return kept.dropDuplicates(["fp", own]).select(*plain.columns).toDF(*columns)
