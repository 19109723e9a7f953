"""Scalar SQL and shared table expressions of the DuckDB side.

Written from the survey's definitions on its own: it imports nothing from the
code it checks, states its own constants, and goes about things differently
(one row per account with its churn span, value lists per contract, ranks and
window maxima over rows), so that a slip on either side shows.
"""

from __future__ import annotations

# --- scalars -------------------------------------------------------------------

# blank-like characters around names and numbers
BLANKS = "'" + "".join(map(chr, [
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])) + "'"


def key(x: str) -> str:
    """The last ten characters, filled up with zeros on the left."""
    s = f"CAST({x} AS VARCHAR)"
    return f"(repeat('0', greatest(0, 10 - length({s}))) || substr({s}, greatest(1, length({s}) - 9)))"


def bare(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def plain(x: str) -> str:
    """Without acute accents on small vowels."""
    return f"translate({x}, 'áéíóú', 'aeiou')"


def label_of_products(bb: str = "bb_product_id", tv: str = "tv_product_id", vo: str = "vo_product_id") -> str:
    """Number of products, then their names unless it is all three."""
    names = f"list_filter([CASE WHEN {bb} IS NOT NULL THEN 'BB' END, CASE WHEN {tv} IS NOT NULL THEN 'TV' END, " \
            f"CASE WHEN {vo} IS NOT NULL THEN 'VO' END], lambda n: n IS NOT NULL)"
    return (f"CASE len({names}) WHEN 0 THEN NULL WHEN 3 THEN '3P' "
            f"ELSE len({names}) || 'P - ' || array_to_string({names}, '+') END")


def months_of_life_14(x: str) -> str:
    """Single months up to eleven, then to one year, two years, more."""
    up = f"CAST(ceil({x}) AS INTEGER)"
    return (f"CASE WHEN {x} > 24 THEN '2Y+' WHEN {x} > 12 THEN '1Y-2Y' WHEN {x} > 11 THEN '11M-1Y' "
            f"WHEN {x} > 1 THEN ({up} - 1) || 'M-' || {up} || 'M' WHEN {x} IS NOT NULL THEN '1M' END")


def months_of_life_4(x: str) -> str:
    return f"CASE WHEN {x} > 24 THEN '2Y+' WHEN {x} > 12 THEN '1Y-2Y' WHEN {x} > 6 THEN '06-1Y' WHEN {x} <= 6 THEN '6M' END"


def months_of_life_3(x: str) -> str:
    return f"CASE WHEN {x} > 6 THEN '6M+' WHEN {x} > 3 THEN '3M-6M' WHEN {x} <= 3 THEN '3M' END"


def spanish_month(n: str) -> str:
    return ("['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', "
            f"'Noviembre', 'Diciembre'][{n}]")


def int_month(d: str) -> str:
    return f"CAST(extract('month' FROM {d}) AS INTEGER)"


def first_of(d: str) -> str:
    return f"make_date(CAST(year({d}) AS INTEGER), {int_month(d)}, 1)"


def ordinal(d: str) -> str:
    """Months since year zero."""
    return f"(12 * year({d}) + month({d}))"


def direction(a: str, b: str) -> str:
    return f"['WENT DOWN', 'SAME', 'WENT UP'][2 + CAST(sign({b} - {a}) AS INTEGER)]"


def growth(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> 0 THEN {b} / {a} - 1 END"


def half_up(x: str) -> str:
    """Two decimals, halves away from zero, on the decimal form."""
    d = f"CAST({x} AS DECIMAL(28, 10))"
    return f"(sign({d}) * floor(abs({d}) * 100 + 0.5) / 100)"


def cents(x: str) -> str:
    return f"CAST({half_up(x)} AS DECIMAL(18, 2))"


def number(x: str) -> str:
    t = bare(x)
    return (f"CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST({t} AS DOUBLE) END")


NET = cents("vo_mrc - vo_mrc_discount + (bb_mrc - bb_mrc_discount) + (tv_mrc - tv_mrc_discount)")
BILL = cents(f"coalesce({number('vo_billed_raw')}, 0) + bb_billed + tv_billed")

# --- table expressions, each with those it needs --------------------------------

WITH: dict[str, tuple[tuple[str, ...], str]] = {}


def _add(name: str, sql: str, *needs: str) -> None:
    WITH[name] = (needs, sql.strip())


def query(select: str, *names: str) -> str:
    """A statement body: the named expressions with all they need, in order."""
    seen: dict[str, str] = {}

    def visit(name: str) -> None:
        if name not in seen:
            needs, sql = WITH[name]
            for n in needs:
                visit(n)
            seen[name] = sql

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in seen.items())
    return f"{ctes}\n{select.strip()}" if seen else select.strip()


_add("snap", f"""
SELECT *, {key('account_id')} AS contract, CAST(churn_ts AS DATE) AS left_on, {bare('district_code')} AS dist,
       {bare('canton_code')} AS cant, {bare('province_code')} AS prov, {label_of_products()} AS bundle,
       {int_month('snapshot_date')} AS mon, {first_of('snapshot_date')} AS month_day
FROM crm_snapshots""")

_add("quit_order", f"""
SELECT contract, opened_on, sub_reason
FROM (SELECT {key('contract_id')} AS contract, opened_on, sub_reason,
             rank() OVER (PARTITION BY {key('contract_id')} ORDER BY opened_on) AS place
      FROM service_orders
      WHERE order_type = 'DESINSTALACION' AND status IS NOT NULL AND opened_on IS NOT NULL)
WHERE place = 1""")

_add("quit_reason", """
SELECT DISTINCT contract, opened_on, CASE WHEN sub_reason = 'MOROSIDAD' THEN contract END AS involuntary_id,
       CASE WHEN sub_reason <> 'MOROSIDAD' THEN contract END AS voluntary_id
FROM quit_order""", "quit_order")

_add("span", """
SELECT account_id, any_value(contract) AS contract, min(left_on) AS first_left, max(left_on) AS last_left,
       max(snapshot_date) AS last_seen
FROM snap GROUP BY account_id""", "snap")

# per contract: the last days of its accounts that end in their last month, the first days of 2021
_add("days", """
SELECT contract, list(DISTINCT last_left) FILTER (WHERE month(last_left) = month(last_seen)) AS lasts,
       list(DISTINCT first_left) FILTER (WHERE year(first_left) = 2021) AS firsts
FROM span WHERE contract IS NOT NULL GROUP BY contract""", "span")

_add("gone", """
SELECT contract, last_churn, f.first_churn
FROM (SELECT contract, unnest(lasts) AS last_churn, firsts FROM days) d, unnest(d.firsts) AS f(first_churn)
WHERE f.first_churn <= last_churn""", "days")

LEAD = f"{ordinal('first_churn')} - {ordinal('opened_on')}"

_add("explained", f"""
SELECT g.contract, q.voluntary_id, q.involuntary_id, g.last_churn, g.first_churn,
       {int_month('last_churn')} AS last_churn_month, {int_month('first_churn')} AS first_churn_month,
       {int_month('opened_on')} AS order_month, opened_on
FROM gone g JOIN quit_reason q USING (contract)
WHERE opened_on <= first_churn AND {LEAD} BETWEEN 0 AND 3""", "gone", "quit_reason")

_add("bundle_start", """
SELECT DISTINCT contract, bundle, day AS bundle_first_churn
FROM (SELECT contract, bundle, min(left_on) OVER (PARTITION BY account_id, bundle) AS day FROM snap)
WHERE year(day) = 2021""", "snap")

# the churners of a place: its accounts' rows there, against the contract's first days
_add("place", f"""
SELECT contract, dist, cant, prov, max(left_on) AS last_churn, max(snapshot_date) AS seen,
       {months_of_life_4('max(age_months)')} AS tenure
FROM snap GROUP BY ALL""", "snap")

_add("place_explained", f"""
SELECT p.contract, p.dist, p.cant, p.prov, p.tenure, p.last_churn, f.first_churn, q.opened_on, q.voluntary_id,
       q.involuntary_id
FROM place p JOIN days d ON d.contract = p.contract, unnest(d.firsts) AS f(first_churn), quit_reason q
WHERE month(p.last_churn) = month(p.seen) AND f.first_churn <= p.last_churn
  AND q.contract = p.contract AND q.opened_on <= f.first_churn AND {LEAD.replace('first_churn', 'f.first_churn')} <= 3
""", "place", "days", "quit_reason")

_add("catalogue", f"""
SELECT {plain('province')} AS province_name, {plain('canton')} AS canton_name, {plain('district')} AS district_name,
       economic_band, ids_2017, [upper({plain('district')}), upper({plain('canton')}), upper({plain('province')})] AS spot
FROM district_index""")

_add("lived", f"""
SELECT DISTINCT account_id, mon, dist, cant, prov, [dist, cant, prov] AS spot,
       {months_of_life_4('max(age_months) OVER (PARTITION BY account_id, snapshot_date)')} AS tenure
FROM snap""", "snap")

_add("listed", f"""
SELECT DISTINCT n.district, a.dist AS district_code, a.contract AS account, a.last_snapshot
FROM (SELECT account_id, contract, dist, max(snapshot_date) AS last_snapshot FROM snap GROUP BY ALL) a
LEFT JOIN (SELECT DISTINCT {plain('district')} AS district FROM district_index) n ON upper(n.district) = a.dist
""", "snap")

_add("installed", """
SELECT DISTINCT contract, install_ts FROM snap WHERE year(install_ts) = 2021""", "snap")

_add("sold", f"""
SELECT DISTINCT {key('contract_id')} AS contract, sold_on, channel
FROM activations
WHERE year(sold_on) = 2021 AND sale_type = 'Nueva' AND movement_type = 'Altas por venta'
  AND customer_type IN ('RESIDENCIAL', 'EMPLEADO', 'PROGRAMA HOGARES CONECTADOS')
  AND reason IN ('VENTA', 'VENTA NUEVA ')""")

_add("cohort", f"""
SELECT contract, sold_on, {int_month('sold_on')} AS sale_month, channel
FROM (SELECT contract, unnest(list_filter(times, lambda x: CAST(x AS DATE) = sold_on)) AS hit, sold_on, channel
      FROM sold JOIN (SELECT contract, list(install_ts) AS times FROM installed GROUP BY contract) USING (contract))
""", "sold", "installed")

# --- revenue: analysis May to July 2021, active July to October -------------------

_add("dated", """
SELECT *, max(snapshot_date) OVER (PARTITION BY month_day) AS month_end,
       max(left_on) OVER (PARTITION BY account_id) AS acct_left, max(snapshot_date) OVER (PARTITION BY account_id) AS acct_seen
FROM snap""", "snap")

_add("asked", """
SELECT month_day AS month, CAST(row_number() OVER (ORDER BY month_day) AS INTEGER) AS month_order
FROM (SELECT DISTINCT month_day FROM snap WHERE year(month_day) = 2021 AND mon BETWEEN 5 AND 7)""", "snap")

HORIZON = "(SELECT max(month) FROM asked) AND CAST((SELECT max(month) FROM asked) + INTERVAL 3 MONTH AS DATE)"

_add("left_after", f"""
SELECT account_id, {first_of('any_value(acct_left)')} AS churn_month
FROM dated GROUP BY account_id
HAVING month(any_value(acct_left)) = month(any_value(acct_seen)) AND {first_of('any_value(acct_left)')} BETWEEN {HORIZON}
""", "dated", "asked")

_add("present", f"""
SELECT DISTINCT account_id, month_day AS active_month, {months_of_life_3('age_months')} AS tenure
FROM snap WHERE year(month_day) = 2021 AND mon BETWEEN 7 AND 10""", "snap")

_add("charge", f"""
SELECT a.month_order, p.active_month, p.tenure, d.account_id, {NET} AS net, {BILL} AS bill
FROM dated d JOIN asked a ON a.month = d.month_day JOIN present p ON p.account_id = d.account_id
WHERE d.snapshot_date = d.month_end AND NOT EXISTS (SELECT 1 FROM left_after x WHERE x.account_id = d.account_id)
""", "dated", "asked", "present", "left_after")

_add("by_month", """
SELECT active_month, tenure, account_id, """ + ", ".join(
    f"CAST(sum({c}) FILTER (WHERE month_order = {k}) AS DOUBLE) AS {n}_{k}"
    for n, c in (("mrc", "net"), ("bill", "bill")) for k in (1, 2, 3)) + """
FROM charge GROUP BY ALL""", "charge")

TRENDS = ", ".join(
    f"{direction(f'{n}_{k}', f'{n}_{k + 1}')} AS {n}_trend_{k}_{k + 1}, "
    f"{growth(f'{n}_{k}', f'{n}_{k + 1}')} AS {n}_change_{k}_{k + 1}" for n in ("mrc", "bill") for k in (1, 2))

# --- month-end charges of every month, with the month before ----------------------

_add("ends", f"""
SELECT account_id, month_day AS month, CAST(sum({NET}) AS DOUBLE) AS mrc
FROM dated WHERE snapshot_date = month_end GROUP BY ALL""", "dated")

_add("steps", """
SELECT e.account_id, e.month, e.mrc,
       (SELECT arg_max([b.mrc], b.month) FROM ends b WHERE b.account_id = e.account_id AND b.month < e.month)[1] AS prev_mrc
FROM ends e""", "ends")
