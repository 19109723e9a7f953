"""DuckDB SQL of the sixteen reports and P09 by month."""

from __future__ import annotations

from subscope.oracle.parts import (
    TRENDS, half_up, int_month, key, months_of_life_14, plain, query, spanish_month,
)

SPLIT = ("count(DISTINCT contract) AS churners, count(DISTINCT voluntary_id) AS voluntary, "
         "count(DISTINCT involuntary_id) AS involuntary")

P01 = query(f"""
SELECT last_churn_month AS month, bundle, {SPLIT}
FROM explained e JOIN bundle_start b USING (contract)
WHERE b.bundle_first_churn = e.first_churn GROUP BY ALL""", "explained", "bundle_start")

P02 = query(f"""
SELECT mon AS month, bundle, {months_of_life_14('oldest')} AS tenure, count(DISTINCT account_id) AS actives
FROM (SELECT account_id, mon, bundle, max(snapshot_date) AS latest, max(age_months) AS oldest,
             max(max(snapshot_date)) OVER (PARTITION BY account_id, mon) AS month_latest
      FROM snap GROUP BY account_id, mon, bundle)
WHERE latest = month_latest AND year(latest) = 2021 GROUP BY ALL""", "snap")

P03 = query(f"""
SELECT last_churn_month AS month, bundle, {months_of_life_14('oldest')} AS tenure, {SPLIT}
FROM (SELECT e.*, b.bundle,
             (SELECT max(s.age_months) FROM snap s WHERE s.contract = e.contract AND s.left_on = e.last_churn) AS oldest
      FROM explained e JOIN bundle_start b ON b.contract = e.contract AND b.bundle_first_churn = e.first_churn)
GROUP BY ALL""", "explained", "bundle_start", "snap")

P04 = query(f"SELECT *, {TRENDS} FROM by_month", "by_month")

P05 = query(f"""
SELECT s.bb_product_id, s.bb_product_name, v.speed_range, count(DISTINCT s.contract) AS customers,
       CAST({half_up('avg(s.bb_mrc)')} AS DOUBLE) AS mean_price
FROM (SELECT DISTINCT contract, bb_product_id, bb_product_name, bb_mrc FROM snap) s,
     (SELECT {key('contract_id')} AS contract, speed_range FROM speed_inventory GROUP BY ALL) v
WHERE s.contract = v.contract GROUP BY ALL""", "snap")

# rows of a churner count once each: a tie of reasons or a repeated catalogue row counts again
_CHURNERS = """
SELECT x.dist AS district_code, x.cant AS canton_code, x.prov AS province_code, {more}count(x.contract) AS churners
FROM (SELECT DISTINCT contract, dist, cant, prov, {tenure}last_churn, first_churn, opened_on, voluntary_id, involuntary_id
      FROM place_explained) x JOIN catalogue c ON c.spot = [x.dist, x.cant, x.prov]
WHERE month(x.last_churn) = {month} GROUP BY ALL"""


def _churners(month: int, more: str = "") -> str:
    return query(_CHURNERS.format(month=month, more=more, tenure="tenure, " if "tenure" in more else ""),
                 "place_explained", "catalogue")


P06 = _churners(8)
P07 = _churners(10, "c.economic_band, x.tenure, ")
P08 = _churners(8, "c.economic_band, c.ids_2017, x.tenure, ")

_WHERE = """prov AS province_code, province_name, cant AS canton_code, canton_name, dist AS district_code, district_name,
       economic_band, {more}count(DISTINCT account_id) AS actives
FROM lived JOIN catalogue USING (spot) WHERE economic_band IS NOT NULL"""

P09 = query(f"SELECT {_WHERE.format(more='ids_2017, tenure, ')} AND mon = 8 GROUP BY ALL", "lived", "catalogue")
P09M = query(f"SELECT mon AS month, {_WHERE.format(more='ids_2017, tenure, ')} GROUP BY ALL", "lived", "catalogue")
P10 = query(f"SELECT mon AS month, {_WHERE.format(more='')} GROUP BY ALL", "lived", "catalogue")

# explained churners by the day they left; ties count again
_RATE = """
SELECT {keys}district, district_code, count(account) AS contracts, CAST(sum(hits) AS BIGINT) AS churners, {rate} AS churn_rate
FROM (SELECT {month}l.*, (SELECT count(*) FROM explained e WHERE e.contract = l.account AND e.last_churn = l.last_snapshot) AS hits
      FROM listed l WHERE district IS NOT NULL)
GROUP BY ALL HAVING sum(hits) > 0"""

P11 = query(_RATE.format(keys="", month="", rate="sum(hits) / count(account)"), "listed", "explained")
P12 = query(_RATE.format(keys="month, ", month=f"{int_month('last_snapshot')} AS month, ",
                         rate=f"CAST({half_up('sum(hits) / count(account)')} AS DOUBLE)"), "listed", "explained")

P13 = f"""
SELECT DISTINCT d.district, s.district_code
FROM (SELECT {plain('district')} AS district FROM district_index) d
LEFT JOIN (SELECT DISTINCT district_code FROM crm_snapshots) s ON s.district_code = upper(d.district)"""

P14 = query("SELECT channel, count(contract) AS sales FROM cohort GROUP BY ALL", "cohort")

P15 = query(f"""
SELECT {spanish_month('month(e.first_churn)')} AS churn_month_name, sale_month, channel, {SPLIT}
FROM explained e JOIN cohort USING (contract) WHERE sold_on < e.first_churn GROUP BY ALL""", "explained", "cohort")

P16 = "SELECT channel, len(list(DISTINCT contract_id)) AS contracts FROM activations GROUP BY ALL"

REPORT_SQL = {
    "bundle_churners_by_month": P01,
    "bundle_active_tenure": P02,
    "bundle_churner_tenure": P03,
    "mrc_non_churner_evolution": P04,
    "plan_speed_price": P05,
    "district_churners": P06,
    "district_churners_tenure": P07,
    "district_churners_ids": P08,
    "district_active_ids": P09,
    "district_active_ids_by_month": P09M,
    "district_active_economic_by_month": P10,
    "district_churn_rate": P11,
    "district_churn_rate_by_month": P12,
    "district_catalog_coverage": P13,
    "new_sales_by_channel": P14,
    "new_sales_churners_by_channel": P15,
    "contracts_by_channel": P16,
}
