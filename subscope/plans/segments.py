"""Reusable segments (G01-G30) registered as queries of their own, so each
one's semantics is checked at scale against the oracle."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.operators import churn as C
from subscope.operators import geography as G
from subscope.operators import history as H
from subscope.operators import orders as O
from subscope.operators import pricing as PR
from subscope.operators import revenue as R
from subscope.operators import sales as S
from subscope.operators.bundles import last_snapshot_bundles
from subscope.params import DEFAULT_PARAMS, ReportParams
from subscope.plans.reports import bundle_churners_by_month
from subscope.sources.tables import Tables

P = DEFAULT_PARAMS


def disconnect_first_orders(t: Tables, p: ReportParams = P) -> DataFrame:
    return O.disconnect_first_orders(t.orders, p)


def disconnect_reason_split(t: Tables, p: ReportParams = P) -> DataFrame:
    return O.disconnect_reason_split(t.orders, p)


def crm_last_churn(t: Tables, p: ReportParams = P) -> DataFrame:
    return C.crm_last_churn(C.churn_roles(C.account_churn_summary(t.crm), p)).select(
        "contract", "last_churn", "last_churn_month"
    ).distinct()


def crm_last_churn_by_location(t: Tables, p: ReportParams = P) -> DataFrame:
    return C.crm_last_churn_by_location(t.crm, with_tenure=False)


def crm_last_churn_by_location_tenure(t: Tables, p: ReportParams = P) -> DataFrame:
    return C.crm_last_churn_by_location(t.crm, with_tenure=True)


def crm_first_churn(t: Tables, p: ReportParams = P) -> DataFrame:
    return C.crm_first_churn(C.churn_roles(C.account_churn_summary(t.crm), p)).select(
        "contract", "first_churn", "first_churn_month"
    ).distinct()


def real_churners(t: Tables, p: ReportParams = P) -> DataFrame:
    roles = C.churn_roles(C.account_churn_summary(t.crm), p)
    return C.real_churners(C.crm_last_churn(roles), C.crm_first_churn(roles))


def churn_order_attribution(t: Tables, p: ReportParams = P) -> DataFrame:
    return C.churn_core(t.crm, t.orders, p)


def bundle_at_first_churn(t: Tables, p: ReportParams = P) -> DataFrame:
    return C.bundle_at_first_churn(C.churn_roles(C.account_churn_summary(t.crm), p))


def last_snapshot_per_account_month(t: Tables, p: ReportParams = P) -> DataFrame:
    return last_snapshot_bundles(t.crm).select(
        "account_id", "month", F.col("month_last").alias("last_snapshot"), "bundle", "max_age"
    )


def churner_age_at_last_churn(t: Tables, p: ReportParams = P) -> DataFrame:
    """Every attributed churner's maximum age and first install date
    over the CRM rows dated on its last churn."""
    summary = C.churn_date_summary(C.with_disconnect_order(t.crm, t.orders, p))
    days = C.contract_days(summary, p, ages="flatten(collect_list(ages))")
    att = C.attributed(days, O.disconnect_reason_split(t.orders, p), p, ("ages",))
    return att.selectExpr("contract", "last_churn", f"{C.on_last_churn('ma')} AS max_age",
                          f"{C.on_last_churn('mi')} AS first_install").distinct()


def account_snapshot_dates(t: Tables, p: ReportParams = P) -> DataFrame:
    return G.account_snapshot_dates(t.crm, with_tenure=True)


def account_locations(t: Tables, p: ReportParams = P) -> DataFrame:
    return G.account_locations(t.crm, with_tenure=True)


def district_catalog_folded(t: Tables, p: ReportParams = P) -> DataFrame:
    return G.district_catalog_folded(t.districts).select(
        "province_name", "canton_name", "district_name", "economic_band", "ids_2017"
    )


def district_match_full(t: Tables, p: ReportParams = P) -> DataFrame:
    m = G.district_match_full(G.account_locations(t.crm), t.districts, p)
    return m.select("account_id", "month", *G.LOCATION, "district_name", "canton_name", "province_name",
                    "economic_band", "ids_2017")


def district_match_name_only(t: Tables, p: ReportParams = P) -> DataFrame:
    return G.district_match_name_only(t.crm, t.districts, p)


def district_contract_counts(t: Tables, p: ReportParams = P) -> DataFrame:
    return G.district_contract_counts(G.district_match_name_only(t.crm, t.districts, p))


def district_churner_counts(t: Tables, p: ReportParams = P) -> DataFrame:
    """G16 rows on the last churn of an attributed churner."""
    counts = G.district_counts(t.crm, t.orders, t.districts, p)
    return counts.where("churners > 0").select("district", "district_code", "churners")


def crm_of_disconnected(t: Tables, p: ReportParams = P) -> DataFrame:
    """The (contract, account, snapshot date) that the churn reports work on,
    by way of the Bloom filter before the semi-join."""
    p = C.with_order_filter(t.orders, p)
    return C.with_disconnect_order(t.crm, t.orders, p).select("contract", "account_id", "snapshot_date").distinct()


def active_rollup(t: Tables, p: ReportParams = P) -> DataFrame:
    """Distinct active accounts by month and every level of the location."""
    return G.active_rollup(t.crm)


def crm_history(t: Tables, p: ReportParams = P) -> DataFrame:
    """The CRM as mergeable facts: the histories of the dates up to the 15th
    of a month and of the later ones, made apart and merged."""
    return _halves_merged(t, H.tasks_for(t.crm))


def _halves_merged(t: Tables, tasks: int) -> DataFrame:
    early = F.dayofmonth("snapshot_date") <= 15
    return H.merged(H.history_of(t.crm.where(early), tasks).unionByName(H.history_of(t.crm.where(~early), tasks)))


def bundle_churners_from_history(t: Tables, p: ReportParams = P) -> DataFrame:
    """P01 from the history in place of the CRM table. The history has at most
    the CRM's rows, so these and the orders, counted, give the tasks of the
    steps by contract."""
    spark, rows = t.crm.sparkSession, t.crm.count()
    history = _halves_merged(t, H.tasks_of(spark, rows))
    p = dataclasses.replace(p, contract_tasks=H.tasks_of(spark, rows + t.orders.count()))
    return bundle_churners_by_month(dataclasses.replace(t, crm=H.as_crm(history)), p)


def crm_installs_in_year(t: Tables, p: ReportParams = P) -> DataFrame:
    return S.crm_installs_in_year(t.crm, p)


def new_residential_sales(t: Tables, p: ReportParams = P) -> DataFrame:
    return S.new_residential_sales(t.activations, p)


def confirmed_sales(t: Tables, p: ReportParams = P) -> DataFrame:
    return S.confirmed_sales(t.crm, t.activations, p)


def churner_months(t: Tables, p: ReportParams = P) -> DataFrame:
    return S.churner_months(C.churn_core(t.crm, t.orders, p))


def analysis_month_order(t: Tables, p: ReportParams = P) -> DataFrame:
    return R.analysis_month_order(t.crm, p)


def churn_month_filter(t: Tables, p: ReportParams = P) -> DataFrame:
    return R.churn_month_filter(t.crm, R.month_bounds(R.analysis_month_order(t.crm, p), p))


def month_last_snapshot(t: Tables, p: ReportParams = P) -> DataFrame:
    return R.month_last_snapshot(t.crm, R.month_bounds(R.analysis_month_order(t.crm, p), p), p)


def active_month_tenure(t: Tables, p: ReportParams = P) -> DataFrame:
    return R.active_month_tenure(t.crm, p)


def account_month_charges(t: Tables, p: ReportParams = P) -> DataFrame:
    return R.account_month_charges(t.crm, p)


def charges_pivot(t: Tables, p: ReportParams = P) -> DataFrame:
    """The pivot over the rows of G27."""
    return R.charges_pivot(R.account_month_charges(t.crm, p), p)


def charge_trend(t: Tables, p: ReportParams = P) -> DataFrame:
    """Labels and relative changes only."""
    df = R.charge_trend(charges_pivot(t, p), p)
    drop = set(R.pivot_columns(p))
    return df.select(*[c for c in df.columns if c not in drop])


def speed_by_contract(t: Tables, p: ReportParams = P) -> DataFrame:
    return PR.speed_by_contract(t.speeds)


def plan_by_account(t: Tables, p: ReportParams = P) -> DataFrame:
    return PR.plan_by_account(t.crm)


SEGMENTS = {
    "disconnect_first_orders": disconnect_first_orders,
    "disconnect_reason_split": disconnect_reason_split,
    "crm_last_churn": crm_last_churn,
    "crm_last_churn_by_location": crm_last_churn_by_location,
    "crm_last_churn_by_location_tenure": crm_last_churn_by_location_tenure,
    "crm_first_churn": crm_first_churn,
    "real_churners": real_churners,
    "churn_order_attribution": churn_order_attribution,
    "bundle_at_first_churn": bundle_at_first_churn,
    "last_snapshot_per_account_month": last_snapshot_per_account_month,
    "churner_age_at_last_churn": churner_age_at_last_churn,
    "account_snapshot_dates": account_snapshot_dates,
    "account_locations": account_locations,
    "district_catalog_folded": district_catalog_folded,
    "district_match_full": district_match_full,
    "district_match_name_only": district_match_name_only,
    "district_contract_counts": district_contract_counts,
    "district_churner_counts": district_churner_counts,
    "crm_of_disconnected": crm_of_disconnected,
    "active_rollup": active_rollup,
    "crm_history": crm_history,
    "bundle_churners_from_history": bundle_churners_from_history,
    "crm_installs_in_year": crm_installs_in_year,
    "new_residential_sales": new_residential_sales,
    "confirmed_sales": confirmed_sales,
    "churner_months": churner_months,
    "analysis_month_order": analysis_month_order,
    "churn_month_filter": churn_month_filter,
    "month_last_snapshot": month_last_snapshot,
    "active_month_tenure": active_month_tenure,
    "account_month_charges": account_month_charges,
    "charges_pivot": charges_pivot,
    "charge_trend": charge_trend,
    "speed_by_contract": speed_by_contract,
    "plan_by_account": plan_by_account,
}
