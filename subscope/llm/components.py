"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., 2014), each round a written table.

Every step is one aggregate (minimum neighbour per node, combined before the
shuffle) and one join on the node, so a node with very many neighbours is
split by the adaptive skew join and never gathered into a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over distinct edges (u > v). Large star: every neighbour
    above a node is linked to the node's minimum; small star: the node and
    its neighbours below it are."""
    both = edges.select("u", "v")
    if larger:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    if larger:
        low = low.select("u", F.least("u", "m").alias("m"))
    j = both.join(low, "u")
    if larger:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an
    edge. ``edges`` may repeat, point either way and hold loops or nulls
    (both ignored)."""
    e = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, seen = stored(e, "edges"), None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        e = stored(_star(_star(e, True), False), "edges")
    else:
        raise RuntimeError("the components did not settle")
    # now every edge is (member, root)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v"), F.col("v")).distinct())
