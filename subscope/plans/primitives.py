"""Primitive operators of SURVEY §2.4-2.10, each exercised by one small
Spark job over the canonical tables (recipes of §2.14), so its semantics are
checked at scale against the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.operators import churn as C
from subscope.operators import geography as G
from subscope.operators import orders as O
from subscope.operators import pricing as PR
from subscope.operators import revenue as R
from subscope.operators import sales as S
from subscope.operators.joins import bounded_broadcast
from subscope.params import DEFAULT_PARAMS, ReportParams
from subscope.sources.tables import Tables

P = DEFAULT_PARAMS


# --- predicates and joins -------------------------------------------------------

def between_scalar_bounds(t: Tables, p: ReportParams = P) -> DataFrame:
    """Snapshots per month, for months between the first sale month and the
    last sale month + horizon (bounds are one scalar subquery)."""
    sm = X.month_start("sold_on")
    b = t.activations.select(F.struct(F.min(sm).alias("lo"), F.max(sm).alias("hi"))).scalar()
    snaps = t.crm.select(X.month_start("snapshot_date").alias("month"))
    j = snaps.where(F.col("month").between(b.getField("lo"), F.add_months(b.getField("hi"), p.churn_horizon_months)))
    return j.groupBy("month").agg(F.count(F.lit(1)).alias("snapshots"))


def join_inner_equi(t: Tables, p: ReportParams = P) -> DataFrame:
    j = PR.plan_by_account(t.crm).join(PR.speed_by_contract(t.speeds), "contract")
    return j.groupBy("speed_range").agg(F.count(F.lit(1)).alias("matches"))


def join_inner_multi_key(t: Tables, p: ReportParams = P) -> DataFrame:
    m = G.district_match_full(G.account_locations(t.crm), t.districts, p)
    return m.groupBy("province_code").agg(F.count(F.lit(1)).alias("matches"))


def join_interval_months(t: Tables, p: ReportParams = P) -> DataFrame:
    roles = C.churn_roles(C.account_churn_summary(t.crm), p)
    real = C.real_churners(C.crm_last_churn(roles), C.crm_first_churn(roles))
    split = O.disconnect_reason_split(t.orders, p).withColumnRenamed("contract", "s_contract")
    lead = X.month_diff("first_churn", "opened_on")
    j = real.join(
        split,
        (real["contract"] == split["s_contract"]) & (real["first_churn"] >= split["opened_on"])
        & (lead <= p.max_order_lead_months),
    )
    return j.groupBy(lead.alias("lead_months")).agg(F.count(F.lit(1)).alias("attributions"))


def join_group_extreme(t: Tables, p: ReportParams = P) -> DataFrame:
    """Disconnect orders on their contract's earliest date, ties and
    duplicates kept: aggregate, then join back on (contract, date). The
    aggregate side has one row per contract; a hot contract on the other
    side is split by AQE's skew-join handling."""
    o = O.disconnect_orders(t.orders, p)
    first = O.disconnect_first_orders(t.orders, p).withColumnRenamed("contract", "f_contract").withColumnRenamed(
        "opened_on", "first_opened_on"
    )
    j = o.join(first, (o["contract"] == first["f_contract"]) & (o["opened_on"] == first["first_opened_on"]))
    return j.select("contract", "opened_on", "sub_reason")


def _folded_catalog_rows(t: Tables) -> DataFrame:
    return t.districts.select(X.strip_acute_accents("district").alias("district")).withColumn(
        "k_district", F.upper("district")
    )


def _trimmed_codes(t: Tables) -> DataFrame:
    return t.crm.select(X.trim_white("district_code").alias("district_code")).distinct()


def join_left_outer(t: Tables, p: ReportParams = P) -> DataFrame:
    cat = _folded_catalog_rows(t)
    codes = _trimmed_codes(t)
    return cat.join(codes, cat["k_district"] == codes["district_code"], "left").select("district", "district_code")


def join_right_outer(t: Tables, p: ReportParams = P) -> DataFrame:
    """Catalogue right-outer distinct CRM codes, written as codes left-outer
    catalogue (the preserved side is the larger one)."""
    cat = _folded_catalog_rows(t)
    codes = _trimmed_codes(t)
    return codes.join(cat, cat["k_district"] == codes["district_code"], "left").select("district", "district_code")


def join_left_anti(t: Tables, p: ReportParams = P) -> DataFrame:
    acc = t.crm.select("account_id", X.trim_white("province_code").alias("province_code")).distinct()
    churned = t.crm.where(F.col("churn_ts").isNotNull()).select("account_id").distinct()
    return acc.join(churned, "account_id", "left_anti").groupBy("province_code").agg(
        F.count(F.lit(1)).alias("accounts")
    )


def join_fanout_active_months(t: Tables, p: ReportParams = P) -> DataFrame:
    """Month-end rows x active months of the same account (many-to-many on
    the account: every month-end row repeats once per active (month, tenure)
    of its account)."""
    last = t.crm.groupBy(X.month_start("snapshot_date").alias("month")).agg(
        F.max("snapshot_date").alias("last_date")
    )
    last = bounded_broadcast(last)  # one row per calendar month
    me = t.crm.join(last, t.crm["snapshot_date"] == last["last_date"]).select("account_id", "month")
    j = me.join(R.active_month_tenure(t.crm, p), "account_id")
    return j.groupBy("month", "active_month").agg(F.count(F.lit(1)).alias("rows"))


# --- aggregation ---------------------------------------------------------------------

def agg_min_max(t: Tables, p: ReportParams = P) -> DataFrame:
    return C.account_churn_summary(t.crm).select("account_id", "first_churn", "last_churn", "last_snapshot")


def agg_conditional_sum(t: Tables, p: ReportParams = P) -> DataFrame:
    net = X.net_recurring_charge()
    mo = F.month("snapshot_date")
    months = [d.month for d in p.analysis_months]
    lo, hi = min(p.analysis_months), R._month_end(max(p.analysis_months))
    rows = t.crm.where(F.col("snapshot_date").between(F.lit(lo), F.lit(hi)))
    return rows.groupBy("account_id").agg(
        *[F.sum(F.when(mo == k, net)).cast("double").alias(f"mrc_m{k}") for k in months]
    )


def agg_avg_round(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.groupBy("bb_product_id").agg(X.round2(F.avg("bb_mrc")).alias("mean_bb_mrc"))


def agg_count_non_null(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.orders.groupBy("order_type").agg(F.count("sub_reason").alias("reasons"))


def agg_count_distinct(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.orders.groupBy("order_type").agg(F.count_distinct("contract_id").alias("contracts"))


def agg_multi_count_distinct(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.orders.groupBy("order_type").agg(
        F.count_distinct("contract_id").alias("contracts"),
        F.count_distinct("sub_reason").alias("reasons"),
        F.count_distinct("opened_on").alias("open_dates"),
    )


def agg_ratio(t: Tables, p: ReportParams = P) -> DataFrame:
    per = t.crm.groupBy(X.trim_white("province_code").alias("province_code"), "account_id").agg(
        F.max(F.col("churn_ts").isNotNull().cast("int")).alias("churned")
    )
    g = per.groupBy("province_code").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("churned").cast("long").alias("churned_accounts")
    )
    return g.withColumn("churn_ratio", F.col("churned_accounts") / F.col("accounts"))


def distinct_rows(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.select("account_id", "bb_product_id", "bb_mrc").distinct()


# --- window, sort ----------------------------------------------------------------------

def window_row_number(t: Tables, p: ReportParams = P) -> DataFrame:
    """Snapshot months numbered in calendar order. The window has no
    partition key; its input is one row per calendar month."""
    months = t.crm.select(X.month_start("snapshot_date").alias("month")).distinct()
    return months.withColumn("month_number", F.row_number().over(Window.orderBy("month")))


def order_by_calendar_month(t: Tables, p: ReportParams = P) -> DataFrame:
    cm = S.churner_months(C.churn_core(t.crm, t.orders, p))
    g = cm.groupBy("churn_month_name").agg(F.count_distinct("contract").alias("churners"))
    return g.orderBy(X.month_number_es("churn_month_name"))


# --- scalar functions ------------------------------------------------------------------

def pad_contract_key(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.orders.select("contract_id", X.pad_key("contract_id").alias("contract")).distinct()


def trim_location(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.select(
        *[x for c in G.LOCATION for x in (F.col(c), X.trim_white(c).alias(f"{c}_trimmed"))]
    ).distinct()


def strip_acute_accents(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.districts.select(
        *[x for c in ("district", "canton", "province") for x in (F.col(c), X.strip_acute_accents(c).alias(f"{c}_folded"))]
    )


def _churn_install(t: Tables) -> DataFrame:
    """Every churn and install time, rows without a churn included."""
    return t.crm.select("account_id", "churn_ts", "install_ts").distinct()


def date_parts(t: Tables, p: ReportParams = P) -> DataFrame:
    return _churn_install(t).select(
        "account_id", "churn_ts", F.month("churn_ts").alias("churn_month"), F.year("churn_ts").alias("churn_year"),
        F.month("install_ts").alias("install_month"), F.year("install_ts").alias("install_year"),
    )


def timestamp_to_date(t: Tables, p: ReportParams = P) -> DataFrame:
    return _churn_install(t).select(
        "account_id", "churn_ts", F.to_date("churn_ts").alias("churn_date"), F.to_date("install_ts").alias("install_date")
    )


def date_trunc_month(t: Tables, p: ReportParams = P) -> DataFrame:
    return _churn_install(t).select(
        "account_id", "churn_ts", X.month_start("churn_ts").alias("churn_month_start"),
        X.month_start("install_ts").alias("install_month_start"),
    )


def date_add_months(t: Tables, p: ReportParams = P) -> DataFrame:
    return _churn_install(t).select(
        "account_id", "churn_ts",
        F.add_months(F.to_date("churn_ts"), p.churn_horizon_months).alias("churn_plus_horizon"),
        F.add_months(F.to_date("install_ts"), p.churn_horizon_months).alias("install_plus_horizon"),
    )


def date_diff_calendar_months(t: Tables, p: ReportParams = P) -> DataFrame:
    return _churn_install(t).select(
        "account_id", "churn_ts", X.month_diff(F.to_date("churn_ts"), F.to_date("install_ts")).alias("months_to_churn")
    )


def round_half_away(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.select(
        "bb_mrc", X.round2(F.col("bb_mrc") / 8).alias("eighth_rounded")
    ).distinct()


def safe_cast_double(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.select("vo_billed_raw", X.number_from_text("vo_billed_raw").alias("vo_billed")).distinct()


def coalesce_zero(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.select(
        "vo_billed_raw", "bb_billed", "tv_billed", X.billed_total().cast("double").alias("billing_total")
    ).distinct()


def _month_end_mrc(t: Tables, p: ReportParams) -> DataFrame:
    """Net charge per (account, month) on the month's table-wide last snapshot
    and the previous month's value (window over at most one row per month
    and account, after the aggregate)."""
    last = t.crm.groupBy(X.month_start("snapshot_date").alias("month")).agg(F.max("snapshot_date").alias("last_date"))
    last = bounded_broadcast(last)  # one row per calendar month
    rows = t.crm.join(last, t.crm["snapshot_date"] == last["last_date"])
    per = rows.groupBy("account_id", "month").agg(F.sum(X.net_recurring_charge()).cast("double").alias("mrc"))
    w = Window.partitionBy("account_id").orderBy("month")
    return per.withColumn("prev_mrc", F.lag("mrc").over(w))


def relative_change(t: Tables, p: ReportParams = P) -> DataFrame:
    return _month_end_mrc(t, p).select(
        "account_id", "month", "prev_mrc", "mrc", X.relative_change("prev_mrc", "mrc").alias("change")
    )


def trend_label(t: Tables, p: ReportParams = P) -> DataFrame:
    return _month_end_mrc(t, p).select(
        "account_id", "month", "prev_mrc", "mrc", X.trend_label("prev_mrc", "mrc").alias("trend")
    )


def bundle_flag(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.groupBy(X.bundle_flag().alias("bundle")).agg(F.count(F.lit(1)).alias("snapshots"))


def tenure_band_14(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.groupBy(X.tenure_band_14("age_months").alias("tenure")).agg(F.count(F.lit(1)).alias("snapshots"))


def tenure_band_4(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.groupBy(X.tenure_band_4("age_months").alias("tenure")).agg(F.count(F.lit(1)).alias("snapshots"))


def tenure_band_3(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.crm.groupBy(X.tenure_band_3("age_months").alias("tenure")).agg(F.count(F.lit(1)).alias("snapshots"))


def month_name_es(t: Tables, p: ReportParams = P) -> DataFrame:
    return t.activations.groupBy(X.month_name_es(F.month("sold_on")).alias("sale_month_name")).agg(
        F.count(F.lit(1)).alias("sales")
    )


PRIMITIVES = {
    "between_scalar_bounds": between_scalar_bounds,
    "join_inner_equi": join_inner_equi,
    "join_inner_multi_key": join_inner_multi_key,
    "join_interval_months": join_interval_months,
    "join_group_extreme": join_group_extreme,
    "join_left_outer": join_left_outer,
    "join_right_outer": join_right_outer,
    "join_left_anti": join_left_anti,
    "join_fanout_active_months": join_fanout_active_months,
    "agg_min_max": agg_min_max,
    "agg_conditional_sum": agg_conditional_sum,
    "agg_avg_round": agg_avg_round,
    "agg_count_non_null": agg_count_non_null,
    "agg_count_distinct": agg_count_distinct,
    "agg_multi_count_distinct": agg_multi_count_distinct,
    "agg_ratio": agg_ratio,
    "distinct_rows": distinct_rows,
    "window_row_number": window_row_number,
    "order_by_calendar_month": order_by_calendar_month,
    "pad_contract_key": pad_contract_key,
    "trim_location": trim_location,
    "strip_acute_accents": strip_acute_accents,
    "date_parts": date_parts,
    "timestamp_to_date": timestamp_to_date,
    "date_trunc_month": date_trunc_month,
    "date_add_months": date_add_months,
    "date_diff_calendar_months": date_diff_calendar_months,
    "round_half_away": round_half_away,
    "safe_cast_double": safe_cast_double,
    "coalesce_zero": coalesce_zero,
    "relative_change": relative_change,
    "trend_label": trend_label,
    "bundle_flag": bundle_flag,
    "tenure_band_14": tenure_band_14,
    "tenure_band_4": tenure_band_4,
    "tenure_band_3": tenure_band_3,
    "month_name_es": month_name_es,
}
