"""Invariants of SURVEY §5 item 4 on the sf0.01 test data."""

import pytest
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.plans import reports as RP
from subscope.plans import segments as SG
from subscope.sources.fixtures import fixture_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF)


def test_bundle_sum_at_least_distinct_churners(t):
    """An account can count in several bundles (T15), never in none."""
    p01 = RP.bundle_churners_by_month(t)
    per_month = {r.month: r.s for r in p01.groupBy("month").agg(F.sum("churners").alias("s")).collect()}
    att = SG.churn_order_attribution(t)
    distinct = {r.last_churn_month: r.n for r in att.groupBy("last_churn_month").agg(
        F.count_distinct("contract").alias("n")).collect()}
    for month, n in distinct.items():
        assert per_month.get(month, 0) >= n


def test_split_within_churners(t):
    for r in RP.bundle_churners_by_month(t).collect():
        assert r.voluntary <= r.churners and r.involuntary <= r.churners


def test_bands_partition_non_null_ages(t):
    for fn in (X.tenure_band_14, X.tenure_band_4, X.tenure_band_3):
        df = t.crm.select(F.col("age_months").isNull().alias("null_age"), fn("age_months").alias("band"))
        bad = df.where(F.col("null_age") != F.col("band").isNull()).count()
        assert bad == 0


def test_churn_rate_bounds(t):
    """Tied orders of different reasons count a churner again (T9), once for
    each of the three reason classes and pair of churn days."""
    for r in RP.district_churn_rate(t).collect():
        assert 0 < r.churn_rate and r.churners <= 6 * r.contracts


def test_attribution_one_open_date_per_contract(t):
    att = SG.churn_order_attribution(t)
    assert att.groupBy("contract").agg(F.count_distinct("order_month").alias("n")).where("n > 1").count() == 0


def test_revenue_report_one_row_per_account_month_tenure(t):
    p04 = RP.mrc_non_churner_evolution(t)
    assert p04.count() == p04.select("active_month", "tenure", "account_id").distinct().count()
