"""Physical-plan properties that matter at scale."""

import pytest

from subscope.plans.reports import REPORTS
from subscope.sources.fixtures import fixture_tables
from tests.conftest import SF_SMALL


def _plan(spark, key):
    df = REPORTS[key](fixture_tables(spark, SF_SMALL))
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(REPORTS))
def test_no_python_and_no_cartesian(spark, key):
    plan = _plan(spark, key)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "FlatMapGroupsInPandas"):
        assert bad not in plan, f"{key}: {bad}"


@pytest.mark.parametrize("key", sorted(REPORTS))
def test_no_nested_loop_join(spark, key):
    """Scalar bounds are scalar subqueries, never a cross join."""
    assert "BroadcastNestedLoopJoin" not in _plan(spark, key), key


def test_revenue_report_has_no_large_join(spark):
    """P04 is one per-account aggregate: the only joins are against the
    month-end dates and the one-row bounds (both broadcast, bounded)."""
    plan = _plan(spark, "mrc_non_churner_evolution")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_literal_segment_uses_anti_join(spark):
    from subscope.plans.segments import account_month_charges

    plan = account_month_charges(fixture_tables(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


@pytest.mark.parametrize("key", [
    "bundle_churners_by_month", "bundle_churner_tenure", "district_churners", "district_churners_tenure",
    "district_churners_ids", "district_churn_rate", "district_churn_rate_by_month", "new_sales_churners_by_channel",
])
def test_churn_core_scans_crm_source_once(spark, key):
    """The CRM aggregate of a churn report has one consumer, or its exchange
    is reused."""
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = REPORTS[key](fixture_tables(spark, SF_SMALL))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan or len(re.findall(r"Generate explode\(\[?.*12\]?\)|Generate explode\(\[1,2", plan)) <= 1
