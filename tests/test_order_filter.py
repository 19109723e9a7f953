"""The Bloom filter before the churn semi-join."""

import re

import pytest
from pyspark.sql import functions as F

from subscope.operators import churn as C
from subscope.operators import order_filter as B
from subscope.params import DEFAULT_PARAMS as P
from subscope.plans import reports as RP
from subscope.plans.registry import builders
from subscope.sources.fixtures import fixture_tables
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("keys, expected", [(1, 1), (300, 300), (20_000, 20_000), (20_000, 15_000), (0, 10)])
def test_no_key_is_lost_and_few_others_pass(spark, keys, expected):
    held = spark.range(keys).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("k"))
    rows = spark.range(120_000).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("k"), "id")
    rows = rows.union(rows.limit(3).select(F.lit(None).cast("string"), "id"))
    got = B.maybe_among(rows, "k", held, expected)
    assert got.columns == ["k", "id"]
    assert got.where(F.col("id") < keys).count() >= keys
    others = got.where(F.col("id") >= keys).count()
    assert others <= (0.004 if expected == keys else 0.02) * 120_000, others


def test_beyond_the_bound_all_rows_pass(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("k"))
    assert B.maybe_among(rows, "k", rows.limit(1), B.KEYS_PER_BLOCK * B.MOST_BLOCKS + 1) is rows


def test_filter_stands_before_the_exchange(spark):
    t = fixture_tables(spark, SF_SMALL)
    p = C.with_order_filter(t.orders, P)
    contracts = C.disconnect_orders(t.orders, P).select("contract").distinct()
    assert contracts.count() <= p.order_filter_keys <= 1.3 * contracts.count() + 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = C.with_disconnect_order(t.crm, t.orders, p)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi, moved, test = (re.search(x, plan).start() for x in ("SortMergeJoin", "Exchange hashpartitioning", "BroadcastHashJoin"))
    assert semi < moved < test
    kept = C.with_disconnect_order(t.crm, t.orders, P).count()
    passed = B.maybe_among(C.keyed(t.crm), "contract", contracts, p.order_filter_keys).count()
    assert kept <= passed <= 1.1 * kept


@pytest.mark.parametrize("key", ["bundle_churners_by_month", "bundle_churner_tenure", "district_churners_tenure",
                                 "new_sales_churners_by_channel"])
def test_reports_do_not_depend_on_the_filter(edge, key):
    p = C.with_order_filter(edge.orders, P)
    assert p.order_filter_keys is not None
    assert sorted(map(str, RP.REPORTS[key](edge, p).collect())) == sorted(map(str, builders()[key](edge, P).collect()))
