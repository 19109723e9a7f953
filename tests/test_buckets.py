"""Bucketed storage: the churn reports read the CRM where it lies."""

import re
import tempfile

import pytest

from subscope.oracle.compare import same, spark_result
from subscope.operators import churn as C
from subscope.plans import reports as RP
from subscope.sources.buckets import read_bucketed, write_bucketed
from tests.edge_fixture import tables_from_rows
from tests.random_fixture import random_tables

BUCKETS = 5


@pytest.fixture(scope="module")
def world(spark):
    return tables_from_rows(spark, random_tables(31))


@pytest.fixture(scope="module")
def root(spark, world):
    path = tempfile.mkdtemp(prefix="subscope-buckets-") + "/t"
    write_bucketed(world, spark, path, BUCKETS)
    return path


@pytest.fixture(scope="module")
def bucketed(spark, root):
    return read_bucketed(spark, root, prefix="bucketed_")


def _plan(spark, df) -> str:
    """The static plan without broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _above(plan: str, table: str) -> list[str]:
    """The operators above each scan of ``table`` up to the root of the plan."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if re.search(rf"FileScan parquet .*{table}", line):
            depth, path = len(re.match(r"[\s:|+\-]*", line).group()), []
            for up in reversed(lines[:i]):
                d = len(re.match(r"[\s:|+\-]*", up).group())
                if d < depth:
                    depth = d
                    path.append(up.strip(" :+-"))
            out.append(path)
    return out


@pytest.mark.parametrize("key", sorted(RP.REPORTS))
def test_every_report_is_the_same(world, bucketed, key):
    ok, why = same(spark_result(RP.REPORTS[key](bucketed)), spark_result(RP.REPORTS[key](world)))
    assert ok, why


@pytest.mark.parametrize("key", ["bundle_churners_by_month", "bundle_churner_tenure", "new_sales_churners_by_channel"])
def test_no_exchange_between_the_crm_and_the_counts(spark, bucketed, key):
    for table in ("bucketed_crm_snapshots", "bucketed_service_orders"):
        paths = _above(_plan(spark, lambda: RP.REPORTS[key](bucketed)), table)
        assert paths
        for path in paths:
            below = []
            for op in path:  # from the scan upwards to the first exchange: it moves counts
                if "Exchange" in op:
                    break
                below.append(op)
            assert any("SortMergeJoin" in op for op in below)
            assert any("partial_sum(" in op for op in below), path
            moves = [op for op in path if "Exchange" in op]
            assert len(moves) == 2 and "rangepartitioning" in moves[1], moves  # the counts and their order


def test_plain_files_do_move_the_crm(spark, world):
    plan = _plan(spark, lambda: RP.bundle_churners_by_month(world))
    assert len(re.findall(r"Exchange hashpartitioning\(contract", plan)) >= 1


def test_layout(spark, root, bucketed):
    import glob

    dates = bucketed.crm.select("snapshot_date").distinct().count()
    files = glob.glob(f"{root}/crm_snapshots/snapshot_date=*/*.parquet")
    assert 0 < len(files) <= dates * BUCKETS
    assert len(glob.glob(f"{root}/service_orders/*.parquet")) <= BUCKETS
    plan = bucketed.crm.where("snapshot_date = DATE'2021-08-31'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_read_again_and_written_over(spark, root, world):
    """Another session declares the tables anew; overwriting keeps nothing old."""
    again = read_bucketed(spark, root, prefix="again_")
    assert again.crm.count() == world.crm.count() and again.orders.count() == world.orders.count()
    path = tempfile.mkdtemp(prefix="subscope-buckets-") + "/t"
    write_bucketed(world, spark, path, 3)
    write_bucketed(world, spark, path, 2, mode="overwrite")
    other = read_bucketed(spark, path, prefix="other_")
    ok, why = same(spark_result(C.keyed(other.crm)), spark_result(C.keyed(world.crm)))
    assert ok, why
    with pytest.raises(ValueError):
        write_bucketed(world, spark, path, 0)


def test_cli_reads_buckets_and_history(spark, root, world):
    from subscope.cli import main
    from subscope.operators.history import add_snapshots

    out = tempfile.mkdtemp(prefix="subscope-cli-")
    add_snapshots(spark, f"{out}/history", world.crm)
    for more in (["--bucketed"], ["--bucketed", "--history", f"{out}/history"]):
        names = ["bundle_churners_by_month", "district_active_ids"]
        written = main(["--tables", root, "--out", f"{out}/{len(more)}", *more,
                        *[x for n in names for x in ("--report", n)]], spark=spark)
        for name, path in zip(names, written):
            ok, why = same(spark_result(spark.read.parquet(path)), spark_result(RP.REPORTS[name](world)))
            assert ok, why
