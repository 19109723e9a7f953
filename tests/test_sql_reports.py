"""The reports as table functions of Spark SQL."""

import dataclasses
import re

import pytest

from subscope.oracle.compare import same, spark_result
from subscope.oracle.sql import CALLED
from subscope.params import DEFAULT_PARAMS, ReportParams
from subscope.plans import reports as R
from subscope.plans.sql_reports import FUNCTIONS, SQL_REPORTS, register_report_functions
from subscope.sources.fixtures import fixture_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    t = fixture_tables(spark, SF)
    register_report_functions(spark, t)
    return t


@pytest.fixture
def large(spark):
    """As on a large cluster: nothing broadcast by size, static plans."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def _equal(a, b):
    ok, why = same(spark_result(a), spark_result(b))
    assert ok, why


def _shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    return len(re.findall("Exchange hashpartitioning", plan))


def test_every_report_is_a_function():
    assert set(R.REPORTS) <= set(FUNCTIONS)
    assert {f"sql_{k}" for k in CALLED} == set(SQL_REPORTS)


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_same_rows_columns_and_shuffles(spark, tables, large, name):
    via_sql, report = spark.sql(f"SELECT * FROM {name}()"), FUNCTIONS[name].like(tables, DEFAULT_PARAMS)
    assert [(f.name, f.dataType) for f in via_sql.schema] == [(f.name, f.dataType) for f in report.schema]
    assert _shuffles(via_sql) == _shuffles(report)
    _equal(via_sql, report)


CALLS = [
    ("bundle_churners_by_month(2020, 3)", R.bundle_churners_by_month, dict(year=2020)),
    ("bundle_churners_by_month(lead_months => 1)", R.bundle_churners_by_month, dict(max_order_lead_months=1)),
    ("bundle_churner_tenure(2021, 0)", R.bundle_churner_tenure, dict(max_order_lead_months=0)),
    ("bundle_active_tenure(2020)", R.bundle_active_tenure, dict(year=2020)),
    ("district_churners(NULL)", R.district_churners, dict(churn_month_district=None)),
    ("district_churners_tenure(8, 2021, 1)", R.district_churners_tenure, dict(churn_month_tenure=8, max_order_lead_months=1)),
    ("district_churners_ids(churn_month => NULL, lead_months => 2)", R.district_churners_ids,
     dict(churn_month_ids=None, max_order_lead_months=2)),
    ("district_active_ids(10)", R.district_active_ids, dict(active_month=10)),
    ("district_churn_rate(2021, 1)", R.district_churn_rate, dict(max_order_lead_months=1)),
    ("district_churn_rate_by_month(2021, 0)", R.district_churn_rate_by_month, dict(max_order_lead_months=0)),
    ("new_sales_by_channel(2021, 5)", R.new_sales_by_channel, dict(sale_month=5)),
    ("new_sales_by_channel(2020)", R.new_sales_by_channel, dict(year=2020)),
    ("new_sales_churners_by_channel(sale_in_month => 5)", R.new_sales_churners_by_channel, dict(sale_month=5)),
]


@pytest.mark.parametrize("call, report, given", CALLS, ids=[c for c, _, _ in CALLS])
def test_arguments(spark, tables, large, call, report, given):
    via_sql = spark.sql(f"SELECT * FROM {call}")
    want = report(tables, dataclasses.replace(ReportParams(), **given))
    assert _shuffles(via_sql) == _shuffles(want)
    _equal(via_sql, want)


@pytest.mark.parametrize("call, report, given", CALLS, ids=[c for c, _, _ in CALLS])
def test_arguments_on_edge_rows(spark, edge, call, report, given):
    register_report_functions(spark, edge, names=[call.split("(")[0]])
    _equal(spark.sql(f"SELECT * FROM {call}"), report(edge, dataclasses.replace(ReportParams(), **given)))


def test_years_of_a_table_as_arguments(spark, tables):
    register_report_functions(spark, tables, names=["bundle_churners_by_month"])
    got = spark.sql("""SELECT y, f.* FROM VALUES (2020), (2021), (2022) AS v(y), LATERAL bundle_churners_by_month(v.y, 2) AS f""")
    want = None
    for y in (2020, 2021, 2022):
        one = R.bundle_churners_by_month(tables, ReportParams(year=y, max_order_lead_months=2)).selectExpr(f"{y} AS y", "*")
        want = one if want is None else want.union(one)
    _equal(got, want)


def test_month_of_the_actives_reaches_the_scan(spark, tables):
    """The argument is a filter of the CRM scan, as in the report."""
    register_report_functions(spark, tables, names=["district_active_ids"])
    plan = spark.sql("SELECT * FROM district_active_ids(9)")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"month\(.*\) = 9", plan)


def test_revenue_function_filters_the_active_month(spark, tables):
    got = spark.sql("SELECT * FROM mrc_non_churner_evolution(DATE '2021-08-01')")
    _equal(got, R.mrc_non_churner_evolution(tables).where("active_month = DATE '2021-08-01'"))


def test_strict_status_is_set_when_registered(spark, edge):
    p = ReportParams(strict_status=True)
    register_report_functions(spark, edge, p, ["bundle_churners_by_month"])
    _equal(spark.sql("SELECT * FROM bundle_churners_by_month()"), R.bundle_churners_by_month(edge, p))


def test_command_line(spark, tmp_path):
    from subscope import cli
    from subscope.sources.tables import write_tables

    root = str(tmp_path / "in")
    t = fixture_tables(spark, "/root/testdata/sf0.001")
    write_tables(t, root)
    written = cli.main(["--tables", root, "--out", str(tmp_path / "out"), "--sql", "SELECT * FROM contracts_by_channel()",
                        "--sql", "SELECT sum(churners) AS n FROM district_churners(NULL)"], spark)
    assert [w.rsplit("/", 1)[1] for w in written] == ["sql_1", "sql_2"]
    _equal(spark.read.parquet(written[0]), R.contracts_by_channel(t))
    want = R.district_churners(t, ReportParams(churn_month_district=None)).selectExpr("sum(churners) AS n")
    _equal(spark.read.parquet(written[1]), want)
