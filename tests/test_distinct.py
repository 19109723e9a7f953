"""Dense ids and bitmaps against plain distinct counts, and how evenly the
work of the district reports is dealt."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from subscope.operators import distinct as D
from subscope.operators import geography as G
from subscope.sources.fixtures import fixture_tables
from tests.conftest import SF_SMALL


def random_rows(spark, seed, n=6000, accounts=900):
    rng = random.Random(seed)
    rows = [(rng.choice(["big"] * 6 + [f"d{i}" for i in range(9)] + [None]), rng.randrange(3),
             None if rng.random() < 0.05 else f"a{rng.randrange(accounts)}") for _ in range(n)]
    return spark.createDataFrame(rows, "place string, month int, account string").repartition(7)


@pytest.mark.parametrize("seed, near", [(1, "place"), (2, "place"), (3, None)])
def test_equal_to_count_distinct(spark, seed, near):
    rows = random_rows(spark, seed)
    ids = D.dense_ids(rows, "account", near, cells=8)
    n = rows.select("account").dropna().distinct().count()
    assert sorted(r.id for r in ids.collect()) == list(range(n))
    maps = D.bitmaps(rows, ["place", "month"], "account", ids)
    for groups in (["place", "month"], ["place"], ["month"], []):
        got = D.counts(D.merged(maps, groups), groups, "n")
        want = rows.dropna(subset="account").groupBy(*groups).agg(F.count_distinct("account").alias("n"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tables_of_two_days_merge(spark):
    rows = random_rows(spark, 4)
    ids = D.dense_ids(rows, "account", "place")
    one, two = (D.bitmaps(rows.where(f"month = {m}"), ["place"], "account", ids) for m in (0, 1))
    got = D.counts(D.merged(one.union(two), ["place"]), ["place"], "n")
    want = rows.where("month < 2").dropna(subset="account").groupBy("place").agg(F.count_distinct("account").alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_large_place_is_many_cells(spark):
    rows = spark.range(40_000).selectExpr("concat('a', id) AS account", "if(id % 10 < 6, 'big', concat('d', id % 400)) AS place")
    ids = D.dense_ids(rows, "account", "place")
    assert ids.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first() == (0, 39_999, 40_000)
    sizes = rows.groupBy("place", F.expr(f"pmod(xxhash64(account), {D.CELLS})")).count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * 24_000 / D.CELLS
    # 32768 ids a bitmap: the accounts of a small place share one or two
    maps = D.bitmaps(rows, ["place"], "account", ids)
    assert maps.where("place <> 'big'").groupBy("place").count().agg(F.max("count")).first()[0] <= 2


def test_null_and_empty(spark):
    rows = random_rows(spark, 5).where("account IS NULL")
    assert D.dense_ids(rows, "account").count() == 0
    assert D.bitmaps(rows, ["place"], "account", D.dense_ids(rows, "account")).count() == 0


@pytest.mark.parametrize("with_tenure", [False, True])
def test_a_capital_of_most_rows_is_dealt_evenly(spark, with_tenure):
    crm = fixture_tables(spark, SF_SMALL).crm
    for c in G.LOCATION:
        crm = crm.withColumn(c, F.when(F.crc32("account_id") % 10 < 6, "CAPITAL").otherwise(F.col(c)))
    located = G.account_locations(crm, with_tenure)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in located.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * median(sizes)
        plan = G.active_counts(located)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moves = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    # outermost first: partial counts by place, then rows by account
    assert len(moves) == 2 and "account_id" in moves[1] and "account_id" not in moves[0]
    assert "partial_count" in plan.split("hashpartitioning(")[1]
