"""Counters of the input traps against plain counts of the same rows."""

import pytest

from subscope.oracle.compare import same, spark_result
from subscope.operators.traps import warnings, watched
from subscope.plans.reports import REPORTS
from tests.edge_fixture import tables_from_rows
from tests.random_fixture import random_tables

ROWS = random_tables(41)


def _number(text):
    try:
        float(text)
    except ValueError:
        return False
    return True


def _expected():
    crm, orders = ROWS["crm_snapshots"], ROWS["service_orders"]
    years = [r["snapshot_date"].year for r in crm]
    gone = [r for r in orders if r["order_type"] == "DESINSTALACION"]
    ids = lambda rows, c: dict(
        row_count=len(rows), long_ids=sum(len(r[c]) > 10 for r in rows), short_ids=sum(len(r[c]) < 10 for r in rows))
    return {
        "crm_snapshots": dict(**ids(crm, "account_id"), first_year=min(years), last_year=max(years), unread_bills=sum(
            r["vo_billed_raw"] is not None and not _number(r["vo_billed_raw"]) for r in crm)),
        "service_orders": dict(**ids(orders, "contract_id"),
                               disconnects_without_status=sum(r["status"] is None for r in gone),
                               disconnects_without_day=sum(r["opened_on"] is None for r in gone)),
    }


@pytest.fixture(scope="module")
def world(spark):
    return tables_from_rows(spark, ROWS)


@pytest.mark.parametrize("key, reads", [("bundle_churners_by_month", ["crm_snapshots", "service_orders"]),
                                        ("district_churn_rate", ["crm_snapshots", "service_orders"]),
                                        ("bundle_active_tenure", ["crm_snapshots"]), ("contracts_by_channel", [])])
def test_counts_equal_brute_force(world, key, reads):
    t, watch = watched(world)
    report = REPORTS[key](t)
    ok, why = same(spark_result(report), spark_result(REPORTS[key](world)))
    assert ok, why
    assert watch.counts(report) == {name: _expected()[name] for name in reads}


def test_warnings_name_the_traps_that_occur():
    got = [w[:2] for w in warnings(_expected())]
    assert got == ["T1", "T7", "T1", "T7", "T2", "T8"]
    assert warnings({}) == []
    several = dict(_expected()["crm_snapshots"], first_year=2020)
    assert any(w.startswith("T5: snapshots are of the years 2020 to 2021") for w in warnings({"crm_snapshots": several}))


def test_cli_writes_counts_next_to_the_report(spark, world, tmp_path, caplog):
    from subscope.cli import main
    from subscope.sources.tables import write_tables

    write_tables(world, str(tmp_path / "t"))
    with caplog.at_level("WARNING", logger="subscope"):
        main(["--tables", str(tmp_path / "t"), "--out", str(tmp_path / "o"), "--report", "bundle_churners_by_month",
              "--report", "contracts_by_channel", "--watch"], spark=spark)
    got = spark.read.parquet(str(tmp_path / "o" / "bundle_churners_by_month_counts"))
    counts = {(r["table"], r["counter"]): r["n"] for r in got.collect()}
    assert counts == {(t, c): n for t, own in _expected().items() for c, n in own.items()}
    assert not (tmp_path / "o" / "contracts_by_channel_counts").exists()
    assert any("bundle_churners_by_month: T2" in m for m in caplog.messages)


def test_reports_without_counters_are_as_before(world):
    plan = REPORTS["bundle_churners_by_month"](world)._jdf.queryExecution().optimizedPlan().toString()
    assert "CollectMetrics" not in plan
