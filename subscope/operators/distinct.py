"""Exact distinct counts that merge: dense ids and bitmaps.

``count(DISTINCT account)`` of a district says nothing about its province,
because an account may live in two districts. Bitmaps of dense account ids
can be or-ed, so one pass at the finest level gives every coarser one, and
the months or parts counted today can be kept and merged with tomorrow's.

Ids are dense (0 to n - 1) and close together for accounts of one place, so
that a place's bitmaps are few and full. They take two passes: the keys are
dealt over cells, each cell is numbered by itself, and the cells' sizes,
summed in order, give the offsets. A place of many accounts is many cells,
so none gathers its accounts in one task; neither do the bitmaps, which hold
32768 ids each and are built where the rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 64  # of one place


def dense_ids(rows: DataFrame, key: str, near: str | None = None, cells: int = CELLS) -> DataFrame:
    """(key, id): 0 to n - 1 for the distinct non-null values of ``key``,
    neighbours sharing their least value of ``near``. The order within a cell
    is that of the keys, so ids do not depend on the partitioning."""
    keys = rows.where(f"{key} IS NOT NULL").groupBy(key).agg(F.expr(f"min({near}) AS near") if near else F.expr("1 AS near"))
    dealt = keys.withColumn("cell", F.expr(f"pmod(xxhash64({key}), {cells})"))
    sizes = dealt.groupBy("near", "cell").agg(F.expr("count(1) AS n"))
    # one row a cell, so the one ordered window over all of them is small
    offsets = sizes.selectExpr(
        "near AS o_near", "cell AS o_cell",
        "coalesce(sum(n) OVER (ORDER BY near, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset")
    numbered = dealt.selectExpr(key, "near", "cell", f"row_number() OVER (PARTITION BY near, cell ORDER BY {key}) AS place")
    j = numbered.join(offsets, numbered["near"].eqNullSafe(offsets["o_near"]) & (numbered["cell"] == offsets["o_cell"]))
    return j.selectExpr(key, "offset + place - 1 AS id")


def bitmaps(rows: DataFrame, groups: list[str], key: str, ids: DataFrame) -> DataFrame:
    """(groups, bucket, bits): the distinct keys of each group, a row for
    every 32768 ids that occur in it. Null keys count nowhere."""
    j = rows.select(*groups, key).join(ids, key)
    return j.groupBy(*groups, F.expr("bitmap_bucket_number(id + 1) AS bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(id + 1)) AS bits"))


def merged(maps: DataFrame, groups: list[str]) -> DataFrame:
    """Bitmaps of coarser groups, or of several tables united."""
    return maps.groupBy(*groups, "bucket").agg(F.expr("bitmap_or_agg(bits) AS bits"))


def counts(maps: DataFrame, groups: list[str], name: str) -> DataFrame:
    """The number of distinct keys of each group."""
    return maps.groupBy(*groups).agg(F.expr(f"sum(bitmap_count(bits)) AS {name}"))
