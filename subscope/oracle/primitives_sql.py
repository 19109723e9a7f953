"""DuckDB SQL of the primitive-operator jobs."""

from __future__ import annotations

from subscope.oracle.parts import (
    BILL, LEAD, NET, bare, direction, first_of, growth, half_up, int_month, key, label_of_products, months_of_life_3,
    months_of_life_4, months_of_life_14, number, plain, query, spanish_month,
)

_TIMES = "(SELECT account_id, churn_ts, install_ts FROM crm_snapshots GROUP BY ALL)"


def _count(label: str, name: str, table: str = "crm_snapshots", unit: str = "snapshots") -> str:
    return f"SELECT {label} AS {name}, count(*) AS {unit} FROM {table} GROUP BY ALL"


PRIMITIVE_SQL = {
    "between_scalar_bounds": query(f"""
SELECT month_day AS month, count(*) AS snapshots
FROM snap, (SELECT min(sold_on) AS lo, max(sold_on) AS hi FROM activations)
WHERE month_day >= {first_of('lo')} AND month_day <= CAST({first_of('hi')} + INTERVAL 3 MONTH AS DATE)
GROUP BY ALL""", "snap"),
    "join_inner_equi": query(f"""
SELECT speed_range, CAST(sum(plans) AS BIGINT) AS matches
FROM (SELECT DISTINCT {key('contract_id')} AS contract, speed_range FROM speed_inventory)
JOIN (SELECT contract, count(DISTINCT (bb_product_name, bb_product_id, bb_mrc)) AS plans FROM snap GROUP BY contract)
  USING (contract)
GROUP BY ALL""", "snap"),
    "join_inner_multi_key": query("""
SELECT prov AS province_code, count(*) AS matches
FROM (SELECT DISTINCT account_id, mon, prov, spot FROM lived) JOIN catalogue USING (spot) GROUP BY ALL""", "lived", "catalogue"),
    "join_interval_months": query(f"""
SELECT CAST({LEAD} AS INTEGER) AS lead_months, count(*) AS attributions FROM explained GROUP BY ALL""", "explained"),
    "join_group_extreme": query("SELECT * FROM quit_order", "quit_order"),
    "join_left_outer": query(f"""
SELECT d.district, s.dist AS district_code
FROM (SELECT {plain('district')} AS district FROM district_index) d
LEFT JOIN (SELECT DISTINCT dist FROM snap) s ON s.dist = upper(d.district)""", "snap"),
    "join_right_outer": query(f"""
SELECT d.district, s.dist AS district_code
FROM (SELECT DISTINCT dist FROM snap) s
LEFT JOIN (SELECT {plain('district')} AS district FROM district_index) d ON s.dist = upper(d.district)""", "snap"),
    "join_left_anti": query("""
SELECT prov AS province_code, count(DISTINCT account_id) AS accounts
FROM snap WHERE account_id IN (SELECT account_id FROM span WHERE last_left IS NULL) GROUP BY ALL""", "span"),
    "join_fanout_active_months": query("""
SELECT d.month_day AS month, p.active_month, count(*) AS rows
FROM dated d JOIN present p USING (account_id) WHERE d.snapshot_date = d.month_end GROUP BY ALL""", "dated", "present"),
    "agg_min_max": query("""
SELECT account_id, first_left AS first_churn, last_left AS last_churn, last_seen AS last_snapshot FROM span""", "span"),
    "agg_conditional_sum": query("SELECT account_id, " + ", ".join(
        f"CAST(sum({NET}) FILTER (WHERE mon = {m}) AS DOUBLE) AS mrc_m{m}" for m in (5, 6, 7)) + """
FROM snap WHERE year(snapshot_date) = 2021 AND mon IN (5, 6, 7) GROUP BY account_id""", "snap"),
    "agg_avg_round": f"""
SELECT bb_product_id, CAST({half_up('sum(bb_mrc) / nullif(count(bb_mrc), 0)')} AS DOUBLE) AS mean_bb_mrc
FROM crm_snapshots GROUP BY ALL""",
    "agg_count_non_null": """
SELECT order_type, count(*) - count(*) FILTER (WHERE sub_reason IS NULL) AS reasons FROM service_orders GROUP BY ALL""",
    "agg_count_distinct": "SELECT order_type, len(list(DISTINCT contract_id)) AS contracts FROM service_orders GROUP BY ALL",
    "agg_multi_count_distinct": """
SELECT order_type, len(list(DISTINCT contract_id)) AS contracts,
       coalesce(len(list(DISTINCT sub_reason) FILTER (WHERE sub_reason IS NOT NULL)), 0) AS reasons,
       coalesce(len(list(DISTINCT opened_on) FILTER (WHERE opened_on IS NOT NULL)), 0) AS open_dates
FROM service_orders GROUP BY ALL""",
    "agg_ratio": query("""
SELECT prov AS province_code, count(*) AS accounts, count(*) FILTER (WHERE left_ever) AS churned_accounts,
       count(*) FILTER (WHERE left_ever) / count(*) AS churn_ratio
FROM (SELECT prov, account_id, bool_or(left_on IS NOT NULL) AS left_ever FROM snap GROUP BY ALL) GROUP BY ALL""", "snap"),
    "distinct_rows": "SELECT account_id, bb_product_id, bb_mrc FROM crm_snapshots GROUP BY ALL",
    "window_row_number": query("""
SELECT DISTINCT month_day AS month, CAST(dense_rank() OVER (ORDER BY month_day) AS INTEGER) AS month_number FROM snap""", "snap"),
    "order_by_calendar_month": query(f"""
SELECT {spanish_month('first_churn_month')} AS churn_month_name, count(DISTINCT contract) AS churners
FROM explained GROUP BY ALL""", "explained"),
    "pad_contract_key": f"SELECT contract_id, {key('contract_id')} AS contract FROM service_orders GROUP BY ALL",
    "trim_location": "SELECT DISTINCT " + ", ".join(
        f"{c}, {bare(c)} AS {c}_trimmed" for c in ("district_code", "canton_code", "province_code")) + " FROM crm_snapshots",
    "strip_acute_accents": "SELECT " + ", ".join(
        f"{c}, {plain(c)} AS {c}_folded" for c in ("district", "canton", "province")) + " FROM district_index",
    "date_parts": f"""
SELECT account_id, churn_ts, {int_month('churn_ts')} AS churn_month, CAST(year(churn_ts) AS INTEGER) AS churn_year,
       {int_month('install_ts')} AS install_month, CAST(year(install_ts) AS INTEGER) AS install_year
FROM {_TIMES}""",
    "timestamp_to_date": f"""
SELECT account_id, churn_ts, CAST(churn_ts AS DATE) AS churn_date, CAST(install_ts AS DATE) AS install_date FROM {_TIMES}""",
    "date_trunc_month": f"""
SELECT account_id, churn_ts, {first_of('churn_ts')} AS churn_month_start, {first_of('install_ts')} AS install_month_start
FROM {_TIMES}""",
    "date_add_months": f"""
SELECT account_id, churn_ts, CAST(CAST(churn_ts AS DATE) + INTERVAL 3 MONTH AS DATE) AS churn_plus_horizon,
       CAST(CAST(install_ts AS DATE) + INTERVAL 3 MONTH AS DATE) AS install_plus_horizon
FROM {_TIMES}""",
    "date_diff_calendar_months": f"""
SELECT account_id, churn_ts,
       CAST(12 * (year(churn_ts) - year(install_ts)) + month(churn_ts) - month(install_ts) AS INTEGER) AS months_to_churn
FROM {_TIMES}""",
    "round_half_away": f"""
SELECT DISTINCT bb_mrc, CAST({half_up('bb_mrc / 8')} AS DOUBLE) AS eighth_rounded FROM crm_snapshots""",
    "safe_cast_double": f"SELECT DISTINCT vo_billed_raw, {number('vo_billed_raw')} AS vo_billed FROM crm_snapshots",
    "coalesce_zero": f"""
SELECT DISTINCT vo_billed_raw, bb_billed, tv_billed, CAST({BILL} AS DOUBLE) AS billing_total FROM crm_snapshots""",
    "relative_change": query(f"""
SELECT account_id, month, prev_mrc, mrc, {growth('prev_mrc', 'mrc')} AS change FROM steps""", "steps"),
    "trend_label": query(f"""
SELECT account_id, month, prev_mrc, mrc, {direction('prev_mrc', 'mrc')} AS trend FROM steps""", "steps"),
    "bundle_flag": _count(label_of_products(), "bundle"),
    "tenure_band_14": _count(months_of_life_14("age_months"), "tenure"),
    "tenure_band_4": _count(months_of_life_4("age_months"), "tenure"),
    "tenure_band_3": _count(months_of_life_3("age_months"), "tenure"),
    "month_name_es": _count(spanish_month("month(sold_on)"), "sale_month_name", "activations", "sales"),
}
