"""The sixteen reports (P01-P16) as DataFrame builders.

Every builder takes the canonical :class:`~subscope.sources.tables.Tables`
and a :class:`~subscope.params.ReportParams` and returns a lazy DataFrame;
nothing is collected. Output columns are the stable names used by the query
registry and the oracle SQL.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.operators import churn as C
from subscope.operators import geography as G
from subscope.operators import revenue as R
from subscope.operators import sales as S
from subscope.operators.bundles import last_snapshot_bundles
from subscope.operators.orders import disconnect_reason_split
from subscope.operators.pricing import plan_speed_price as _plan_speed_price
from subscope.params import DEFAULT_PARAMS, ReportParams
from subscope.sources.tables import Tables


def churn_counts(df: DataFrame, keys: list, contract: str = "contract") -> DataFrame:
    """churners / voluntary / involuntary = distinct contracts, distinct
    voluntary ids, distinct involuntary ids per group.

    The two id columns hold the contract itself or NULL, so the three
    distinct counts equal: one row per (group, contract) with "has a
    voluntary / involuntary row" flags, then a count and two sums. The first
    step is keyed by the contract (already the partitioning of the join that
    feeds it), the second only shuffles one partial row per group and task;
    no Expand of the input is needed.
    """
    per = df.groupBy(*keys, contract).agg(
        F.expr("max(int(voluntary_id IS NOT NULL)) AS v"), F.expr("max(int(involuntary_id IS NOT NULL)) AS i"))
    return per.groupBy(*keys).agg(
        F.expr("count(1) AS churners"), F.expr("sum(v) AS voluntary"), F.expr("sum(i) AS involuntary"))


# --- bundles -----------------------------------------------------------------

def bundle_churners_by_month(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Attributed churners per month of the last churn and bundle held
    at the first churn, split voluntary / involuntary. An account whose
    bundle changed on its first-churn date counts in each bundle (T15)."""
    summary = C.account_churn_summary(C.with_disconnect_order(t.crm, t.orders, p))
    att = C.attributed(C.contract_days(summary, p), disconnect_reason_split(t.orders, p), p, ("bundles",))
    j = _with_bundle(att).withColumnRenamed("last_churn_month", "month")
    return churn_counts(j, ["month", "bundle"]).orderBy("month", "bundle")


def _with_bundle(att: DataFrame) -> DataFrame:
    """One row per bundle that the contract held on its first churn."""
    return att.selectExpr("*", "explode(transform(filter(bundles, b -> b.day = first_churn), b -> b.bundle)) AS bundle")


def bundle_active_tenure(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Active accounts per month, bundle on the month's last snapshot and
    14-band tenure of the maximum age under that bundle in the month.

    (account, month, bundle) is unique after G10, so a plain count equals
    the distinct count of accounts."""
    g = last_snapshot_bundles(t.crm).where(F.year("bundle_last") == p.year)
    out = g.groupBy("month", "bundle", X.tenure_band_14("max_age").alias("tenure")).agg(
        F.count(F.lit(1)).alias("actives")
    )
    # labels kept; their calendar rank orders the rows
    return out.orderBy("month", X.band_rank("tenure"), "bundle")


def bundle_churner_tenure(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """P01 split by the 14-band tenure of the churner's maximum age over
    the CRM rows dated on its last churn."""
    summary = C.churn_date_summary(C.with_disconnect_order(t.crm, t.orders, p))
    days = C.contract_days(summary, p, ages="flatten(collect_list(ages))")
    att = C.attributed(days, disconnect_reason_split(t.orders, p), p, ("bundles", "ages"))
    j = _with_bundle(att).withColumnRenamed("last_churn_month", "month")
    j = j.withColumn("oldest", F.expr(C.on_last_churn("ma"))).withColumn("tenure", X.tenure_band_14("oldest"))
    return churn_counts(j, ["month", "bundle", "tenure"]).orderBy("month", X.band_rank("tenure"), "bundle")


# --- revenue -------------------------------------------------------------------

def mrc_non_churner_evolution(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Month-over-month net recurring charge and bill of accounts with no
    churn in the horizon, per active month and 3-band tenure."""
    # Ordered by active month (descending) as required; the account and tenure
    # tie-breakers let the range partitioner split each month, whose rows
    # would otherwise all sort in one task (there are only a few months).
    return R.non_churner_charge_evolution(t.crm, p).orderBy(F.desc("active_month"), "account_id", "tenure")


# --- plans and speeds -----------------------------------------------------------

def plan_speed_price(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Broadband plan x speed range: customers and mean price."""
    return _plan_speed_price(t.crm, t.speeds).orderBy("bb_product_id", "customers")


# --- districts --------------------------------------------------------------------

def _district_churners(t: Tables, p: ReportParams, month: int | None, with_tenure: bool,
                       extra: list[str]) -> DataFrame:
    counts = C.churners_by_place(t.crm, t.orders, p, month, with_tenure)
    # catalogue rows are not made distinct: repeated ones count again
    j = G.district_match_full(counts, t.districts, p)
    keys = [*G.LOCATION, *extra]
    return j.groupBy(*keys).agg(F.expr("sum(churners) AS churners")).orderBy(*G.LOCATION)


def district_churners(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Attributed churners per trimmed district / canton / province
    matched to the catalogue, for one month of the last churn."""
    return _district_churners(t, p, p.churn_month_district, False, [])


def district_churners_tenure(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """P06 by economic band and 4-band tenure."""
    return _district_churners(t, p, p.churn_month_tenure, True, ["economic_band", "tenure"])


def district_churners_ids(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """P07 with the development index."""
    return _district_churners(t, p, p.churn_month_ids, True, ["economic_band", "ids_2017", "tenure"])


_CATALOGUE = ["province_name", "canton_name", "district_name"]
_NAMES = ["province_code", "province_name", "canton_code", "canton_name", "district_code", "district_name"]


def district_active_ids(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Active accounts by district (both spellings), economic band,
    index and 4-band tenure, for one month or all; catalogue matches with a
    band only (T13). ``p.by_active_month`` adds the month to the columns and
    the grouping."""
    month = ["month"] if p.by_active_month else []
    crm = t.crm if p.active_month is None else t.crm.where(F.month("snapshot_date") == p.active_month)
    located = G.account_locations(crm, with_tenure=True)
    if p.active_month is None and not p.by_active_month:  # an account of several months counts once
        located = located.drop("month").distinct()
    names = [*_CATALOGUE, "economic_band", "ids_2017"]
    out = G.with_catalogue(G.active_counts(located), t.districts.where("economic_band IS NOT NULL"), names)
    return out.select(*month, *_NAMES, "economic_band", "ids_2017", "tenure", "actives").orderBy(
        *month, "province_code", "canton_code", "district_code")


def district_active_ids_by_month(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """P09 with its month switch on: every month, split by month."""
    return district_active_ids(t, dataclasses.replace(p, active_month=None, by_active_month=True))


def district_active_economic_by_month(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """P10: active accounts per month, district (both spellings) and band."""
    counts = G.active_counts(G.account_locations(t.crm))
    out = G.with_catalogue(counts, t.districts.where("economic_band IS NOT NULL"), [*_CATALOGUE, "economic_band"])
    return out.select("month", *_NAMES, "economic_band", "actives").orderBy(
        "month", "province_code", "canton_code", "district_code")


def _district_rate(t: Tables, p: ReportParams, by_month: bool) -> DataFrame:
    # name-only match drops the NULL district; only districts with a churner
    return G.district_counts(t.crm, t.orders, t.districts, p, by_month).where("district IS NOT NULL AND churners > 0")


def district_churn_rate(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Churn rate per district over the whole period (per month of the
    last snapshot too with ``p.by_month``). ``p.inspect`` returns the
    per-district contract counts (G17) instead, NULL district included."""
    if p.inspect:
        return G.district_contract_counts(G.district_match_name_only(t.crm, t.districts, p)).orderBy("district")
    g = _district_rate(t, p, by_month=p.by_month).withColumn("churn_rate", F.col("churners") / F.col("contracts"))
    return g.orderBy(F.desc("churn_rate"), "contracts", "churners", "district", "district_code")


def district_churn_rate_by_month(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Churn rate per month of the last snapshot and district, rounded
    to 2 decimals (definition T12)."""
    g = _district_rate(t, p, by_month=True).withColumn(
        "churn_rate", X.round2(F.col("churners") / F.col("contracts"))
    )
    return g.orderBy("month", "district", "district_code")


def district_catalog_coverage(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Every folded catalogue district with the raw (untrimmed) CRM code
    that matches it, NULL when none does. Both sides are deduplicated before
    the join, so the join is between two small relations."""
    names = G.district_names_folded(t.districts)
    codes = t.crm.select("district_code").distinct()
    j = names.join(codes, names["k_district"] == codes["district_code"], "left")
    return j.select("district", "district_code").distinct().orderBy("district", "district_code")


# --- sales ------------------------------------------------------------------------

def new_sales_by_channel(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Confirmed new residential sales per channel (cohort size)."""
    s = S.confirmed_sales(t.crm, t.activations, p)
    keys = ["sale_month", "channel"] if p.by_sale_month else ["channel"]
    return s.groupBy(*keys).agg(F.count("contract").alias("sales")).orderBy("sales")


def new_sales_churners_by_channel(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Confirmed sales that later churned (sale before the first churn),
    by month name of the first churn, sale month and channel."""
    summary = C.install_summary(C.with_disconnect_order(t.crm, t.orders, p))
    days = C.contract_days(summary, p, installs="flatten(collect_list(installs))")
    att = C.attributed(days, disconnect_reason_split(t.orders, p), p, ("installs",))
    cm = att.withColumn("churn_month_name", X.month_name_es("first_churn_month"))
    sales = S.new_residential_sales(t.activations, p).withColumn("sale_month", F.month("sold_on"))
    if p.sale_month is not None:
        sales = sales.where(F.col("sale_month") == p.sale_month)
    # a sale is confirmed by an install on its day (in the report year, as the sale is)
    j = cm.join(sales, "contract").where(
        F.array_contains("installs", F.col("sold_on")) & (F.col("sold_on") < F.col("first_churn")))
    out = churn_counts(j, ["churn_month_name", "sale_month", "channel"])
    return out.orderBy(X.month_number_es("churn_month_name"))


def contracts_by_channel(t: Tables, p: ReportParams = DEFAULT_PARAMS) -> DataFrame:
    """Distinct raw contract ids per channel (or subchannel)."""
    key = "subchannel" if p.by_subchannel else "channel"
    return t.activations.groupBy(key).agg(F.count_distinct("contract_id").alias("contracts")).orderBy(
        F.desc("contracts")
    )


REPORTS = {
    "bundle_churners_by_month": bundle_churners_by_month,
    "bundle_active_tenure": bundle_active_tenure,
    "bundle_churner_tenure": bundle_churner_tenure,
    "mrc_non_churner_evolution": mrc_non_churner_evolution,
    "plan_speed_price": plan_speed_price,
    "district_churners": district_churners,
    "district_churners_tenure": district_churners_tenure,
    "district_churners_ids": district_churners_ids,
    "district_active_ids": district_active_ids,
    "district_active_ids_by_month": district_active_ids_by_month,
    "district_active_economic_by_month": district_active_economic_by_month,
    "district_churn_rate": district_churn_rate,
    "district_churn_rate_by_month": district_churn_rate_by_month,
    "district_catalog_coverage": district_catalog_coverage,
    "new_sales_by_channel": new_sales_by_channel,
    "new_sales_churners_by_channel": new_sales_churners_by_channel,
    "contracts_by_channel": contracts_by_channel,
}
