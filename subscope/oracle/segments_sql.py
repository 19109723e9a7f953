"""DuckDB SQL of the segments G01-G30."""

from __future__ import annotations

from subscope.oracle.parts import HORIZON, TRENDS, int_month, key, months_of_life_4, query, spanish_month
from subscope.oracle.reports_sql import P01

_PLACE = """
SELECT contract, last_churn, {month} AS last_churn_month, dist AS district_code, cant AS canton_code,
       prov AS province_code{more}
FROM place WHERE month(last_churn) = month(seen)"""

_LAST_MONTH = int_month("last_churn")

SEGMENT_SQL = {
    "disconnect_first_orders": query("SELECT DISTINCT contract, opened_on FROM quit_order", "quit_order"),
    "disconnect_reason_split": query("SELECT * FROM quit_reason", "quit_reason"),
    "crm_last_churn": query(f"""
SELECT contract, last_churn, {_LAST_MONTH} AS last_churn_month
FROM (SELECT contract, unnest(lasts) AS last_churn FROM days)""", "days"),
    "crm_last_churn_by_location": query(_PLACE.format(month=_LAST_MONTH, more=""), "place"),
    "crm_last_churn_by_location_tenure": query(_PLACE.format(month=_LAST_MONTH, more=", tenure"), "place"),
    "crm_first_churn": query(f"""
SELECT contract, first_churn, {int_month('first_churn')} AS first_churn_month
FROM (SELECT contract, unnest(firsts) AS first_churn FROM days)""", "days"),
    "real_churners": query(f"""
SELECT *, {_LAST_MONTH} AS last_churn_month, {int_month('first_churn')} AS first_churn_month FROM gone""", "gone"),
    "churn_order_attribution": query("SELECT * EXCLUDE (opened_on) FROM explained", "explained"),
    "bundle_at_first_churn": query("SELECT * FROM bundle_start", "bundle_start"),
    "last_snapshot_per_account_month": query("""
SELECT account_id, mon AS month, latest AS last_snapshot, bundle, oldest AS max_age
FROM (SELECT account_id, mon, bundle, max(snapshot_date) AS latest, max(age_months) AS oldest,
             rank() OVER (PARTITION BY account_id, mon ORDER BY max(snapshot_date) DESC) AS place
      FROM snap GROUP BY account_id, mon, bundle)
WHERE place = 1""", "snap"),
    "churner_age_at_last_churn": query("""
SELECT contract, left_on AS last_churn, max(age_months) AS max_age, min(CAST(install_ts AS DATE)) AS first_install
FROM snap s WHERE EXISTS (SELECT 1 FROM explained e WHERE e.contract = s.contract AND e.last_churn = s.left_on)
GROUP BY ALL""", "snap", "explained"),
    "account_snapshot_dates": query(f"""
SELECT account_id, snapshot_date, mon AS month, {months_of_life_4('max(age_months)')} AS tenure
FROM snap GROUP BY account_id, snapshot_date, mon""", "snap"),
    "account_locations": query("""
SELECT account_id, mon AS month, dist AS district_code, cant AS canton_code, prov AS province_code, tenure
FROM lived""", "lived"),
    "district_catalog_folded": query("SELECT * EXCLUDE (spot) FROM catalogue", "catalogue"),
    "district_match_full": query("""
SELECT account_id, mon AS month, dist AS district_code, cant AS canton_code, prov AS province_code, district_name,
       canton_name, province_name, economic_band, ids_2017
FROM (SELECT DISTINCT account_id, mon, dist, cant, prov, spot FROM lived) JOIN catalogue USING (spot)""", "lived", "catalogue"),
    "district_match_name_only": query("SELECT * FROM listed", "listed"),
    "district_contract_counts": query("""
SELECT district, district_code, count(account) AS contracts FROM listed GROUP BY ALL""", "listed"),
    "district_churner_counts": query("""
SELECT district, district_code, count(e.contract) AS churners
FROM listed, explained e WHERE account = e.contract AND last_snapshot = e.last_churn GROUP BY ALL""", "listed", "explained"),
    "crm_of_disconnected": query("""
SELECT DISTINCT contract, account_id, snapshot_date FROM snap WHERE contract IN (SELECT contract FROM quit_order)""",
                                 "snap", "quit_order"),
    "active_rollup": query("""
SELECT mon AS month, CASE grouping(dist, cant, prov) WHEN 0 THEN 'district' WHEN 4 THEN 'canton' WHEN 6 THEN 'province'
                   ELSE 'country' END AS level,
       prov AS province_code, cant AS canton_code, dist AS district_code, count(DISTINCT account_id) AS actives
FROM lived GROUP BY GROUPING SETS ((mon, prov, cant, dist), (mon, prov, cant), (mon, prov), (mon))""", "lived"),
    "crm_history": """
SELECT account_id, make_date(year(snapshot_date), month(snapshot_date), 1) AS month, churn_ts, install_ts,
       CASE WHEN bb_product_id IS NULL THEN 0 ELSE 4 END + CASE WHEN tv_product_id IS NULL THEN 0 ELSE 2 END
       + CASE WHEN vo_product_id IS NULL THEN 0 ELSE 1 END AS owned, district_code, canton_code, province_code,
       max(snapshot_date) AS last_snapshot, max(age_months) AS max_age
FROM crm_snapshots GROUP BY ALL""",
    "bundle_churners_from_history": P01,
    "crm_installs_in_year": query("SELECT * FROM installed", "installed"),
    "new_residential_sales": query("SELECT * FROM sold", "sold"),
    "confirmed_sales": query("SELECT * FROM cohort", "cohort"),
    "churner_months": query(f"""
SELECT contract, last_churn, first_churn, voluntary_id, involuntary_id,
       {spanish_month('first_churn_month')} AS churn_month_name
FROM explained""", "explained"),
    "analysis_month_order": query("SELECT * FROM asked", "asked"),
    "churn_month_filter": query("SELECT * FROM left_after", "left_after"),
    "month_last_snapshot": query(f"""
SELECT DISTINCT month_day AS month, month_end AS last_date FROM dated
WHERE month_day >= (SELECT min(month) FROM asked) AND month_day <= {HORIZON.split(' AND ')[1]}""", "dated", "asked"),
    "active_month_tenure": query("SELECT * FROM present", "present"),
    "account_month_charges": query("""
SELECT month_order, active_month, tenure, account_id, CAST(net AS DOUBLE) AS mrc_total,
       CAST(bill AS DOUBLE) AS billing_total
FROM charge""", "charge"),
    "charges_pivot": query("SELECT * FROM by_month", "by_month"),
    "charge_trend": query(f"SELECT active_month, tenure, account_id, {TRENDS} FROM by_month", "by_month"),
    "speed_by_contract": f"SELECT {key('contract_id')} AS contract, speed_range FROM speed_inventory GROUP BY ALL",
    "plan_by_account": query("""
SELECT contract, bb_product_name, bb_product_id, bb_mrc FROM snap GROUP BY ALL""", "snap"),
}
