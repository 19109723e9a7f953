"""The reports as table functions of Spark SQL, with parameters::

    register_report_functions(spark, tables)
    spark.sql("SELECT * FROM district_churn_rate(2021, 3) WHERE churn_rate > 0.1")
    spark.sql("SELECT * FROM district_churners(churn_month => NULL)")

Each is a temporary SQL function (``RETURNS TABLE``) over views of the same
segments that the DataFrame reports use, so Spark alone parses and plans the
call. The views hold what does not depend on the call's arguments; an argument
only enters as a filter, above the segments' aggregates (the function's
parameters cannot stand inside one) and below the report's own. With literal
arguments such a filter is folded and pushed down as in the DataFrame report:
no join of the arguments is left in the plan.

Arguments: ``report_year`` (2021), ``lead_months`` (3, the order's greatest
lead in calendar months), ``churn_month`` and ``sale_in_month`` (month
numbers, NULL for all), ``active_from`` (first day of a month, NULL for all)
and ``in_month`` (a month number; ``district_active_ids_all_months`` is over
all). What is no filter is fixed when the functions are registered, by their
:class:`~subscope.params.ReportParams`: the status rule, the months of the
charge trend, excluded subchannels. Rows come in no order.

Registering again replaces the functions and their views: a session has them
over one set of tables at a time.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from subscope.functions import exprs as X
from subscope.operators import churn as C
from subscope.operators import geography as G
from subscope.operators import sales as S
from subscope.operators.bundles import last_snapshot_bundles
from subscope.operators.orders import disconnect_reason_split
from subscope.params import DEFAULT_PARAMS, ReportParams
from subscope.plans import reports as R
from subscope.sources.tables import Tables

_YEAR = "report_year INT DEFAULT 2021"
_LEAD = "lead_months INT DEFAULT 3"
_CHURNED = f"year(first_churn) = report_year AND {X.sql_month_diff('first_churn', 'opened_on')} <= lead_months"
_PLACE = "district_code, canton_code, province_code"
_ON_PLACE = "ON district_code = k_district AND canton_code = k_canton AND province_code = k_province"


# --- views: all years, any lead ------------------------------------------------

def _attributed(t: Tables, p: ReportParams, days: DataFrame, *keep: str) -> DataFrame:
    return C.attributed(days, disconnect_reason_split(t.orders, p), p, ("opened_on", *keep))


def _bundle_churners(t: Tables, p: ReportParams) -> DataFrame:
    summary = C.account_churn_summary(C.with_disconnect_order(t.crm, t.orders, p))
    return R._with_bundle(_attributed(t, p, C.contract_days(summary, p), "bundles")).drop("bundles")


def _bundle_churners_aged(t: Tables, p: ReportParams) -> DataFrame:
    summary = C.churn_date_summary(C.with_disconnect_order(t.crm, t.orders, p))
    days = C.contract_days(summary, p, ages="flatten(collect_list(ages))")
    rows = R._with_bundle(_attributed(t, p, days, "bundles", "ages"))
    return rows.selectExpr("*", f"{C.on_last_churn('ma')} AS oldest").drop("bundles", "ages")


def _sale_churners(t: Tables, p: ReportParams) -> DataFrame:
    summary = C.install_summary(C.with_disconnect_order(t.crm, t.orders, p))
    days = C.contract_days(summary, p, installs="flatten(collect_list(installs))")
    sales = S.new_residential_sales(t.activations, p)
    j = _attributed(t, p, days, "installs").join(sales, "contract")
    j = j.where("array_contains(installs, sold_on) AND sold_on < first_churn").drop("installs")
    return j.withColumn("churn_month_name", X.month_name_es("first_churn_month"))


_VIEWS: dict[str, Callable[[Tables, ReportParams], DataFrame]] = {
    "subscope_bundle_churners": _bundle_churners,
    "subscope_bundle_churners_aged": _bundle_churners_aged,
    "subscope_month_bundles": lambda t, p: last_snapshot_bundles(t.crm),
    "subscope_churner_places": lambda t, p: C.churner_places(t.crm, t.orders, p),
    "subscope_catalogue": lambda t, p: G.district_catalog_folded(t.districts),
    "subscope_district_names": lambda t, p: G.district_names_folded(t.districts),
    "subscope_located": lambda t, p: G.account_locations(t.crm, with_tenure=True),
    "subscope_district_facts": lambda t, p: G.district_facts(t.crm, t.orders, p),
    "subscope_confirmed_sales": lambda t, p: S.confirmed_sales(t.crm, t.activations, p),
    "subscope_sale_churners": _sale_churners,
    "subscope_activations": lambda t, p: t.activations,
}


# --- bodies -----------------------------------------------------------------------

def _split(keys: str, rows: str) -> str:
    """Churners by reason: a row a contract first, as ``reports.churn_counts``."""
    return f"""
SELECT {keys}, count(1) AS churners, sum(v) AS voluntary, sum(i) AS involuntary
FROM (SELECT {keys}, contract, max(int(voluntary_id IS NOT NULL)) AS v, max(int(involuntary_id IS NOT NULL)) AS i
      FROM ({rows}) GROUP BY {keys}, contract) GROUP BY {keys}"""


def _churners_by_place(*more: str) -> str:
    tenure = ", tenure" if "tenure" in more else ""
    keys = ", ".join([_PLACE, *more])
    return f"""
SELECT {keys}, sum(n) AS churners
FROM (SELECT {_PLACE}{tenure}, count(1) AS n
      FROM (SELECT *, {X.sql_band('max_age', X.TENURE_4)} AS tenure FROM subscope_churner_places
            WHERE {_CHURNED} AND (churn_month IS NULL OR month(last_churn) = churn_month))
      GROUP BY {_PLACE}{tenure}) JOIN subscope_catalogue {_ON_PLACE}
GROUP BY {keys}"""


def _actives(month: str, rows: str) -> str:
    names = "province_code, province_name, canton_code, canton_name, district_code, district_name"
    return f"""
SELECT {month}{names}, economic_band, ids_2017, tenure, actives
FROM (SELECT {month}{_PLACE}, tenure, count(1) AS actives FROM ({rows}) GROUP BY {month}{_PLACE}, tenure)
JOIN (SELECT DISTINCT k_district, k_canton, k_province, province_name, canton_name, district_name, economic_band, ids_2017
      FROM subscope_catalogue WHERE economic_band IS NOT NULL) {_ON_PLACE}"""


_FACTS = f"FROM subscope_district_facts WHERE first_churn IS NULL OR ({_CHURNED}) GROUP BY district_code"


def _rate(month: str, sums: str, rate: str) -> str:
    return f"""
SELECT district, district_code, {month}contracts, churners, {rate} AS churn_rate
FROM ({sums}) JOIN (SELECT k_district, collect_set(district) AS names FROM subscope_district_names GROUP BY k_district)
  ON district_code = k_district LATERAL VIEW explode(names) AS district
WHERE churners > 0 AND district IS NOT NULL"""


def _monthly_facts() -> str:
    """Sums by code with the months side by side, as the join is by code."""
    sums = ", ".join(f"sum(CASE WHEN month = {m} THEN {c} END) AS {c}_{m}" for m in range(1, 13) for c in ("contracts", "churners"))
    slots = ", ".join(f"{m}, contracts_{m}, churners_{m}" for m in range(1, 13))
    return f"SELECT district_code, stack(12, {slots}) AS (month, contracts, churners) FROM (SELECT district_code, {sums} {_FACTS})"


_SALES = "FROM subscope_confirmed_sales WHERE year(sold_on) = report_year AND (sale_in_month IS NULL OR sale_month = sale_in_month)"
_SALE_ARGS = f"{_YEAR}, sale_in_month INT DEFAULT NULL"
_BUNDLED = f"SELECT *, last_churn_month AS month FROM subscope_bundle_churners WHERE {_CHURNED}"
_AGED = (f"SELECT *, last_churn_month AS month, {X.sql_band('oldest', X.TENURE_14)} AS tenure "
         f"FROM subscope_bundle_churners_aged WHERE {_CHURNED}")
_CHURN_ARGS = f"{_YEAR}, {_LEAD}"


def _by_month(default: int) -> str:
    return f"churn_month INT DEFAULT {default}, {_CHURN_ARGS}"


@dataclasses.dataclass(frozen=True)
class TableFunction:
    """Arguments, body and views of a function. ``like`` gives the DataFrame
    report with its columns; a body of None selects from that report."""

    like: Callable[[Tables, ReportParams], DataFrame]
    args: str = ""
    body: str | None = None
    where: str = ""


def _with(report: Callable, **given) -> Callable[[Tables, ReportParams], DataFrame]:
    return lambda t, p: report(t, dataclasses.replace(p, **given))


FUNCTIONS: dict[str, TableFunction] = {
    "bundle_churners_by_month": TableFunction(R.bundle_churners_by_month, _CHURN_ARGS, _split("month, bundle", _BUNDLED)),
    "bundle_active_tenure": TableFunction(R.bundle_active_tenure, _YEAR, f"""
SELECT month, bundle, tenure, count(1) AS actives
FROM (SELECT month, bundle, {X.sql_band('max_age', X.TENURE_14)} AS tenure FROM subscope_month_bundles
      WHERE year(bundle_last) = report_year) GROUP BY month, bundle, tenure"""),
    "bundle_churner_tenure": TableFunction(R.bundle_churner_tenure, _CHURN_ARGS, _split("month, bundle, tenure", _AGED)),
    "mrc_non_churner_evolution": TableFunction(
        R.mrc_non_churner_evolution, "active_from DATE DEFAULT NULL",
        where="active_from IS NULL OR active_month = active_from"),
    "plan_speed_price": TableFunction(R.plan_speed_price),
    "district_churners": TableFunction(R.district_churners, _by_month(8), _churners_by_place()),
    "district_churners_tenure": TableFunction(
        R.district_churners_tenure, _by_month(10), _churners_by_place("economic_band", "tenure")),
    "district_churners_ids": TableFunction(
        R.district_churners_ids, _by_month(8), _churners_by_place("economic_band", "ids_2017", "tenure")),
    "district_active_ids": TableFunction(
        R.district_active_ids, "in_month INT DEFAULT 8", _actives("", "SELECT * FROM subscope_located WHERE month = in_month")),
    "district_active_ids_all_months": TableFunction(
        _with(R.district_active_ids, active_month=None),
        body=_actives("", f"SELECT DISTINCT account_id, {_PLACE}, tenure FROM subscope_located")),
    "district_active_ids_by_month": TableFunction(
        R.district_active_ids_by_month, body=_actives("month, ", "SELECT * FROM subscope_located")),
    "district_active_economic_by_month": TableFunction(R.district_active_economic_by_month),
    "district_churn_rate": TableFunction(R.district_churn_rate, _CHURN_ARGS, _rate(
        "", f"SELECT district_code, sum(contracts) AS contracts, sum(churners) AS churners {_FACTS}", "churners / contracts")),
    "district_churn_rate_by_month": TableFunction(
        R.district_churn_rate_by_month, _CHURN_ARGS, _rate("month, ", _monthly_facts(), "round(churners / contracts, 2)")),
    "district_catalog_coverage": TableFunction(R.district_catalog_coverage),
    "new_sales_by_channel": TableFunction(R.new_sales_by_channel, _SALE_ARGS, f"""
SELECT channel, count(contract) AS sales {_SALES} GROUP BY channel"""),
    "new_sales_by_month_and_channel": TableFunction(_with(R.new_sales_by_channel, by_sale_month=True), _SALE_ARGS, f"""
SELECT sale_month, channel, count(contract) AS sales {_SALES} GROUP BY sale_month, channel"""),
    "new_sales_churners_by_channel": TableFunction(
        R.new_sales_churners_by_channel, f"{_CHURN_ARGS}, sale_in_month INT DEFAULT NULL",
        _split("churn_month_name, sale_month, channel", f"""
SELECT *, month(sold_on) AS sale_month FROM subscope_sale_churners WHERE {_CHURNED} AND year(sold_on) = report_year
  AND (sale_in_month IS NULL OR month(sold_on) = sale_in_month)""")),
    "contracts_by_channel": TableFunction(R.contracts_by_channel, body="""
SELECT channel, count(DISTINCT contract_id) AS contracts FROM subscope_activations GROUP BY channel"""),
    "contracts_by_subchannel": TableFunction(_with(R.contracts_by_channel, by_subchannel=True), body="""
SELECT subchannel, count(DISTINCT contract_id) AS contracts FROM subscope_activations GROUP BY subchannel"""),
}


def register_report_functions(spark: SparkSession, t: Tables, p: ReportParams = DEFAULT_PARAMS,
                              names: Iterable[str] | None = None) -> list[str]:
    """Register the reports (or those in ``names``) as temporary table
    functions of the session, over views of ``t``. The defaults of the
    arguments are the reports' own, whatever ``p`` says of them."""
    every = dataclasses.replace(p, year=None, max_order_lead_months=None, sale_month=None)
    names = list(FUNCTIONS if names is None else names)
    read = {word for n in names for word in re.findall(r"\w+", FUNCTIONS[n].body or "")}
    for view in read & _VIEWS.keys():
        _VIEWS[view](t, every).createOrReplaceTempView(view)
    for name in names:
        fn = FUNCTIONS[name]
        report = fn.like(t, p)
        body = fn.body
        if body is None:
            report.createOrReplaceTempView(f"subscope_{name}")
            body = f"SELECT * FROM subscope_{name}" + (f" WHERE {fn.where}" if fn.where else "")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in report.schema.fields)
        listed = ", ".join(f"`{f.name}`" for f in report.schema.fields)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({fn.args}) RETURNS TABLE ({columns}) "
                  f"RETURN SELECT {listed} FROM ({body})")
    return names


def called(name: str, p: ReportParams) -> str:
    """The SQL that calls a function with the arguments ``p`` stands for."""
    given = {"report_year": p.year, "lead_months": p.max_order_lead_months, "in_month": p.active_month,
             "sale_in_month": p.sale_month, "churn_month": {
                 "district_churners": p.churn_month_district, "district_churners_tenure": p.churn_month_tenure,
                 "district_churners_ids": p.churn_month_ids}.get(name)}
    names = [a.split()[0] for a in FUNCTIONS[name].args.split(", ") if a]
    args = ", ".join(f"{a} => {'NULL' if given[a] is None else int(given[a])}" for a in names if a in given)
    return f"SELECT * FROM {name}({args})"


def _query(name: str) -> Callable[[Tables, ReportParams], DataFrame]:
    def run(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
        spark = t.crm.sparkSession
        register_report_functions(spark, t, p, [name])
        return spark.sql(called(name, p))

    run.__name__, run.__doc__ = f"sql_{name}", f"The report {name} called as a table function in SQL."
    return run


# the functions that take arguments, as queries of their own
SQL_REPORTS = {f"sql_{name}": _query(name) for name, fn in FUNCTIONS.items() if name in R.REPORTS and fn.args}
