"""The plans that a large cluster gets: no broadcast by size."""

import re

import pytest

from subscope.params import DEFAULT_PARAMS
from subscope.plans.registry import builders
from subscope.sources.fixtures import fixture_tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def plan(spark):
    tables = fixture_tables(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda key: builders()[key](tables, DEFAULT_PARAMS)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("key", sorted(builders()))
def test_every_plan(plan, key):
    text = plan(key)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "FlatMapGroups"):
        assert bad not in text, bad
    # month ends are one row per month and always broadcast: the CRM is never dealt by its few dates
    assert not re.search(r"SortMergeJoin \[snapshot_date", text)


@pytest.mark.parametrize("key, most", [
    ("bundle_churners_by_month", 4), ("bundle_churner_tenure", 4), ("new_sales_churners_by_channel", 6),
    ("district_churners", 5), ("district_churners_tenure", 6), ("district_churners_ids", 6), ("district_churn_rate", 6),
    ("district_churn_rate_by_month", 6), ("district_churner_counts", 6), ("district_active_ids_by_month", 5),
    ("district_active_economic_by_month", 5)])
def test_hash_exchanges(plan, key, most):
    assert len(re.findall("Exchange hashpartitioning", plan(key))) <= most


@pytest.mark.parametrize("key", [
    "district_churners_tenure", "district_churn_rate", "district_active_ids_by_month", "district_active_economic_by_month"])
def test_crm_is_read_once_and_never_dealt_by_place(plan, key):
    text = plan(key)
    lines = [line for line in text.splitlines() if re.match(r"[ :]*[+:]- ", line)]  # not those of a literal's line breaks
    (crm,) = [i for i, line in enumerate(lines) if "/customer.parquet" in line]
    depth = lambda line: re.search("[+:]- ", line).start()
    # the CRM's own path up to the root: the first moves are by account or contract
    path, level = [], depth(lines[crm])
    for line in reversed(lines[:crm]):
        if depth(line) < level:
            level = depth(line)
            path.append(line)
    moves = [line.split("hashpartitioning(")[1] for line in path if "hashpartitioning(" in line]
    assert re.search("account_id|contract", moves[0]), moves
