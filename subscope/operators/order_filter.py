"""A Bloom filter of the contracts with a disconnect order, tested on CRM rows
before they are moved.

The churn reports keep only contracts that have a disconnect order. The exact
semi-join moves every CRM row to find out; the filter drops most others where
they are read. It never drops a row that the join keeps, and the join still
follows, so results do not depend on it.

The filter is blocked: a key sets ``BITS`` bits of one block of 4096 bits, so
a test is one hash join with the broadcast blocks and ``BITS`` bit tests, in
generated code. With ``KEYS_PER_BLOCK`` keys a block (16 bits a key) a block
is 27 % full and about 0.15 % of the other keys pass (0.27 to the power of
five; measured in tests). The broadcast is bounded by ``MOST_BLOCKS`` of 512
bytes, 32 MB; for more than 16 million contracts there is no filter and the
semi-join does all the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.operators.joins import bounded_broadcast

BITS = 5
KEYS_PER_BLOCK = 256
MOST_BLOCKS = 1 << 16


def blocks_for(keys: int) -> int:
    return max(1, -(-keys // KEYS_PER_BLOCK))


def _place(key: str, blocks: int) -> tuple[str, list[str]]:
    """The block of a key and its bits in it, as SQL."""
    return (f"CAST(pmod(xxhash64({key}), {blocks}) AS INT)",
            [f"CAST(shiftrightunsigned(xxhash64({key}, 1), {12 * i}) & 4095 AS INT)" for i in range(BITS)])


def filter_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words): the filter of a key column, 64 words a block."""
    block, bits = _place(key, blocks)
    words = keys.selectExpr(f"{block} AS block", f"explode(array({', '.join(bits)})) AS bit").groupBy(
        "block", F.expr("bit div 64 AS word")).agg(F.expr("bit_or(shiftleft(1L, bit % 64)) AS bits"))
    held = words.groupBy("block").agg(F.expr("map_from_entries(collect_list(struct(CAST(word AS INT), bits))) AS held"))
    return held.selectExpr("block", "transform(sequence(0, 63), i -> coalesce(held[i], 0L)) AS words")


def maybe_among(rows: DataFrame, key: str, keys: DataFrame, expected: int) -> DataFrame:
    """The rows whose ``key`` may be among those of ``keys`` (about
    ``expected`` distinct ones; more only let more rows pass)."""
    blocks = blocks_for(expected)
    if blocks > MOST_BLOCKS:
        return rows
    block, bits = _place(key, blocks)
    passed = " AND ".join(f"getbit(words[{b} div 64], {b} % 64) = 1" for b in bits)
    tested = rows.withColumn("block", F.expr(block)).join(
        bounded_broadcast(filter_blocks(keys, key, blocks)), "block")  # at most MOST_BLOCKS rows of 512 bytes
    return tested.where(passed).select(*rows.columns)


def counted(keys: DataFrame, key: str) -> int:
    """The number of distinct keys to size a filter for (a sketch's estimate,
    a tenth added; one pass, one row to the driver)."""
    return int(1.1 * keys.select(F.approx_count_distinct(key, 0.02)).first()[0]) + 1
