"""The CRM history by increments: merged, replayed and recomputed states are
equal, and the reports that run from a history equal those on the CRM."""

import dataclasses
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from subscope.oracle.compare import same, spark_result
from subscope.operators import churn as C
from subscope.operators import history as H
from subscope.params import ReportParams
from subscope.plans import segments
from subscope.plans.reports import REPORTS
from subscope.sources import fixtures
from subscope.sources.tables import Tables
from tests.edge_fixture import tables_from_rows
from tests.random_fixture import random_tables


def _equal(a, b):
    ok, why = same(spark_result(a), spark_result(b.select(*a.columns)))
    assert ok, why


@pytest.fixture(scope="module")
def world(spark):
    return tables_from_rows(spark, random_tables(21))


@pytest.fixture(scope="module")
def grown(spark, world):
    """A history that was fed in five batches of dates in any order, one of
    them twice."""
    root = tempfile.mkdtemp(prefix="subscope-history-") + "/h"
    dates = [r[0] for r in world.crm.select("snapshot_date").distinct().collect()]
    random.Random(3).shuffle(dates)
    batches = [dates[i::5] for i in range(5)]
    for batch in [*batches, batches[1]]:
        H.add_snapshots(spark, root, world.crm.where(F.col("snapshot_date").isin(batch)))
    return root


def test_increments_equal_recomputation(spark, world, grown):
    whole = H.history_of(world.crm)
    assert 0 < whole.count() < world.crm.count()
    _equal(H.read_history(spark, grown), whole)


@pytest.mark.parametrize("key", H.HISTORY_REPORTS)
@pytest.mark.parametrize("p", [ReportParams(), ReportParams(churn_month_district=None, churn_month_tenure=None,
                                                            churn_month_ids=None)], ids=["default", "all-months"])
def test_reports_run_from_a_history(spark, world, grown, key, p):
    t = Tables(H.as_crm(H.read_history(spark, grown)), world.orders, world.activations, world.speeds, world.districts)
    _equal(REPORTS[key](world, p), REPORTS[key](t, p))


@pytest.mark.parametrize("key", ["mrc_non_churner_evolution", "plan_speed_price"])
def test_a_report_that_needs_more_fails(spark, world, grown, key):
    t = Tables(H.as_crm(H.read_history(spark, grown)), world.orders, world.activations, world.speeds, world.districts)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        REPORTS[key](t).collect()


def test_replay_takes_back_rows(spark, world):
    root = tempfile.mkdtemp(prefix="subscope-history-") + "/h"
    H.add_snapshots(spark, root, world.crm)
    days = sorted(r[0] for r in world.crm.select("snapshot_date").distinct().collect())
    bad, gone = days[3], days[-1].replace(day=1)
    # one date has half its accounts and another age, the last month is withdrawn
    fixed = world.crm.where(~((F.col("snapshot_date") == F.lit(bad)) & (F.crc32("account_id") % 2 == 0))).withColumn(
        "age_months", F.when(F.col("snapshot_date") == F.lit(bad), F.lit(0.0)).otherwise(F.col("age_months"))).where(
        F.col("snapshot_date") < F.lit(gone))
    written = H.replay_dates(spark, root, fixed, [bad, gone, gone])
    assert written == [bad.replace(day=1), gone]
    got = H.read_history(spark, root)
    assert got.where(F.col("month") == F.lit(gone)).count() == 0
    _equal(got, H.history_of(fixed))


def test_nothing_to_add(spark, world):
    root = tempfile.mkdtemp(prefix="subscope-history-") + "/h"
    assert H.add_snapshots(spark, root, world.crm.where("false")) == []
    assert H.replay_dates(spark, root, world.crm, []) == []
    H.add_snapshots(spark, root, world.crm.where("month(snapshot_date) = 7"))
    _equal(H.read_history(spark, root), H.history_of(world.crm.where("month(snapshot_date) = 7")))


def test_an_update_reads_only_its_months(spark, world, grown):
    plan = H.read_history(spark, grown).where("month = DATE'2021-07-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def _rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_groups_a_bounded_number_of_rows(spark, world, monkeypatch):
    monkeypatch.setattr(H, "ROWS_A_TASK", 20, raising=False)
    whole, tasks = H.history_of(world.crm), math.ceil(world.crm.count() / 20)
    assert tasks > 8  # more than the session's shuffle partitions
    got = segments.crm_history(world)
    # both histories keep the tasks that they were dealt to when they are merged
    assert _plan(got).count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in _plan(got)
    assert got.rdd.getNumPartitions() == whole.rdd.getNumPartitions() == tasks
    assert max(_rows_by_task(got)) <= 3 * 20
    _equal(got, whole)


def test_an_update_groups_a_bounded_number_of_rows(spark, world, monkeypatch):
    monkeypatch.setattr(H, "ROWS_A_TASK", 20, raising=False)
    seen, write = [], H._write
    monkeypatch.setattr(H, "_write", lambda s, r, history, m: (seen.append(history), write(s, r, history, m))[1])
    root = tempfile.mkdtemp(prefix="subscope-history-") + "/h"
    early = F.dayofmonth("snapshot_date") <= 15
    H.add_snapshots(spark, root, world.crm.where(early))
    held = H.read_history(spark, root).count()
    H.add_snapshots(spark, root, world.crm.where(~early))
    _equal(H.read_history(spark, root), H.history_of(world.crm))
    rows = [world.crm.where(early).count(), world.crm.where(~early).count() + held]
    for history, n in zip(seen, rows, strict=True):
        assert f", {math.ceil(n / 20)}), REPARTITION_BY_NUM" in _plan(history)
        assert "ENSURE_REQUIREMENTS" not in _plan(history)


def test_the_churners_from_a_history_in_bounded_tasks(spark, world, monkeypatch):
    monkeypatch.setattr(H, "ROWS_A_TASK", 20, raising=False)
    got = segments.bundle_churners_from_history(world)
    tasks = math.ceil(world.crm.count() / 20)
    assert _plan(got).count(f", {tasks}), REPARTITION_BY_NUM") == 2
    _equal(got, REPORTS["bundle_churners_by_month"](world))


def test_the_contracts_of_a_history_in_bounded_tasks(spark, world, monkeypatch):
    monkeypatch.setattr(H, "ROWS_A_TASK", 20, raising=False)
    seen, kept = [], C.with_disconnect_order
    monkeypatch.setattr(C, "with_disconnect_order", lambda *a: (seen.append(kept(*a)), seen[-1])[1])
    got = segments.bundle_churners_from_history(world)
    tasks = math.ceil((world.crm.count() + world.orders.count()) / 20)
    assert tasks > 8  # more than the session's shuffle partitions
    # the history, the contracts and their first orders meet where they are dealt to, none of them sorted for it
    assert _plan(got).count("hashpartitioning(contract#") >= 3
    assert _plan(got).count(f", {tasks}), REPARTITION_BY_NUM") == 3 and "SortMergeJoin" not in _plan(got)
    assert seen[0].rdd.getNumPartitions() == tasks and max(_rows_by_task(seen[0])) < seen[0].count() / 3
    _equal(got, REPORTS["bundle_churners_by_month"](world))


@pytest.mark.parametrize("keys", [None, 100], ids=["plain", "filtered"])
@pytest.mark.parametrize("key", ["bundle_churners_by_month", "bundle_churner_tenure", "district_churners"])
def test_dealt_contracts_change_no_result(spark, world, key, keys):
    accounts = ["7", "0000000007", "990000000007", None, "8"]
    more = world.crm.limit(40).crossJoin(spark.createDataFrame([(a,) for a in accounts], "a string")).withColumn(
        "account_id", F.col("a")).drop("a")
    quits = world.orders.limit(40).crossJoin(spark.createDataFrame([("7",), (None,)], "c string")).withColumn(
        "contract_id", F.col("c")).drop("c")
    t = Tables(world.crm.unionByName(more), world.orders.unionByName(quits).unionByName(quits), world.activations,
               world.speeds, world.districts)
    p = ReportParams(churn_month_district=None)
    _equal(REPORTS[key](t, p), REPORTS[key](t, dataclasses.replace(p, contract_tasks=13, order_filter_keys=keys)))


def test_a_task_makes_the_rows_of_a_bounded_number_of_customers(spark, monkeypatch):
    customer = spark.range(1000).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey").coalesce(1)
    whole = fixtures.crm_from_customer(customer)
    monkeypatch.setattr(fixtures, "CUSTOMERS_A_TASK", 50, raising=False)
    got = fixtures.crm_from_customer(customer)
    assert got.count() == whole.count() and max(_rows_by_task(got)) <= 24 * 50 * 1.5
    _equal(got, whole)
