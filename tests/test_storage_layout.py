"""Round trip through the partitioned storage layout, and the pruning it
enables."""

import dataclasses
import tempfile

import pytest

from subscope.oracle.compare import same, spark_result
from subscope.plans import reports as RP
from subscope.sources.fixtures import fixture_tables
from subscope.sources.tables import read_tables, tables_from_catalog, write_tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="subscope-layout-")
    write_tables(fixture_tables(spark, SF_SMALL), root)
    return read_tables(spark, root)


@pytest.mark.parametrize("key", ["bundle_churners_by_month", "mrc_non_churner_evolution", "district_active_ids"])
def test_reports_equal_after_round_trip(spark, stored, key):
    ok, why = same(spark_result(RP.REPORTS[key](stored)), spark_result(RP.REPORTS[key](fixture_tables(spark, SF_SMALL))))
    assert ok, why


def test_revenue_report_prunes_partitions(spark, stored):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = RP.mrc_non_churner_evolution(stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
    assert "dynamicpruning" in plan.lower()


def test_file_count_follows_the_dates_not_the_tasks(spark):
    import glob

    root = tempfile.mkdtemp(prefix="subscope-files-")
    t = fixture_tables(spark, SF_SMALL)
    spread = dataclasses.replace(t, crm=t.crm.repartition(30))
    write_tables(spread, root)
    dates = glob.glob(f"{root}/crm_snapshots/snapshot_date=*")
    files = glob.glob(f"{root}/crm_snapshots/snapshot_date=*/*.parquet")
    assert len(dates) == 24 and len(files) <= 2 * len(dates)


def test_catalog_tables_with_column_mapping(spark, stored):
    names = {}
    for name, df in stored.as_dict().items():
        names[name] = f"wh_{name}"
        if name == "service_orders":
            df = df.withColumnRenamed("contract_id", "CONTRATO").withColumnRenamed("opened_on", "FECHA")
        df.createOrReplaceTempView(f"wh_{name}")
    t = tables_from_catalog(spark, names, {"service_orders": {"contract_id": "CONTRATO", "opened_on": "FECHA"}})
    key = "bundle_churners_by_month"
    ok, why = same(spark_result(RP.REPORTS[key](t)), spark_result(RP.REPORTS[key](stored)))
    assert ok, why
    with pytest.raises(ValueError):
        tables_from_catalog(spark, {"crm_snapshots": "x"})


def test_cli_runs_reports_on_stored_tables(spark, stored):
    import os

    from subscope.cli import main, params_from, parse_args

    root = tempfile.mkdtemp(prefix="subscope-cli-")
    write_tables(fixture_tables(spark, SF_SMALL), f"{root}/tables")
    out = main(["--tables", f"{root}/tables", "--out", f"{root}/out", "--report", "bundle_churners_by_month",
                "--report", "contracts_by_channel", "--by-subchannel"], spark=spark)
    assert [os.path.basename(p) for p in out] == ["bundle_churners_by_month", "contracts_by_channel"]
    got = spark.read.parquet(out[0])
    ok, why = same(spark_result(got), spark_result(RP.bundle_churners_by_month(fixture_tables(spark, SF_SMALL))))
    assert ok, why
    assert spark.read.parquet(out[1]).columns == ["subchannel", "contracts"]
    p = params_from(parse_args(["--tables", "x", "--out", "y", "--analysis-months", "2021-04,2021-05",
                                "--excluded-subchannels", "A, B", "--year", "2022", "--inspect",
                                "--active-month", "all", "--churn-month-ids", "all", "--by-active-month"]))
    assert p.active_month is None and p.churn_month_ids is None and p.by_active_month and p.churn_month_district == 8
    assert p.year == 2022 and p.excluded_subchannels == ("A", "B") and len(p.analysis_months) == 2 and p.inspect


def test_conform_types_reads_numeric_ids(spark):
    """An export with numeric account / contract ids and LTZ timestamps is
    read by casting to the declared schema."""
    from pyspark.sql import functions as F

    root = tempfile.mkdtemp(prefix="subscope-types-")
    t = fixture_tables(spark, SF_SMALL)
    t.crm.withColumn("account_id", F.col("account_id").cast("long")).withColumn(
        "churn_ts", F.col("churn_ts").cast("timestamp")
    ).write.parquet(f"{root}/crm_snapshots")
    t.orders.withColumn("contract_id", F.col("contract_id").cast("long")).write.parquet(f"{root}/service_orders")
    for name, df in t.as_dict().items():
        if name not in ("crm_snapshots", "service_orders"):
            df.write.parquet(f"{root}/{name}")
    with pytest.raises(Exception):
        read_tables(spark, root).crm.collect()  # declared schema imposed: the long ids do not read as strings
    loose = read_tables(spark, root, conform_types=True)
    ok, why = same(spark_result(RP.bundle_churners_by_month(loose)), spark_result(RP.bundle_churners_by_month(t)))
    assert ok, why


@pytest.mark.parametrize("key", sorted(RP.REPORTS))
def test_crm_scans_per_report(spark, stored, key):
    """On stored tables every report reads the CRM table once; the revenue
    report reads its pruned slices (PLANS.md); the channel count none."""
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = RP.REPORTS[key](stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = len(re.findall(r"FileScan parquet (?:(?!FileScan)[\s\S])*?crm_snapshots\]", plan))
    expected = {"mrc_non_churner_evolution": 4, "contracts_by_channel": 0}.get(key, 1)
    assert scans == expected, (key, scans)
