"""DuckDB CTEs deriving the canonical tables from the driver's base views
(FIXTURES.md §2). Same mapping as :mod:`subscope.sources.fixtures`."""

# half of the churners in August or October, the others spread
_CHURN_MONTH = """CAST(CASE floor({k} / 4) % 4 WHEN 0 THEN 8 WHEN 1 THEN 10 ELSE 1 + (floor({k} / 4) * 7) % 12 END AS INTEGER)"""
_INSTALL_MONTH = "CAST(1 + floor(c_custkey / 12) % 6 AS INTEGER)"
_DAY = "CAST(1 + c_custkey % 28 AS INTEGER)"
_PAD = "CASE WHEN k % 6 = 2 THEN chr(9) || chr(160) WHEN k % 2 = 0 THEN ' ' ELSE '' END"
_QUIT = "(o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"

PRELUDE = f"""
crm_rows_made AS (
  SELECT c_custkey, c_custkey AS k, CAST(mm.m AS INTEGER) AS m, {_CHURN_MONTH.format(k='c_custkey')} AS cm,
         CASE WHEN c_custkey % 28 = 4 AND mm.m > 3 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS nk,
         unnest([make_date(2021, CAST(mm.m AS INTEGER), 10), last_day(make_date(2021, CAST(mm.m AS INTEGER), 1))]) AS snapshot_date
  FROM customer, (SELECT unnest(range(1, 13)) AS m) mm
),
crm_snapshots AS (
  SELECT CASE WHEN k % 100 = 8 AND m > 6 THEN lpad(CAST(k AS VARCHAR), 10, '0')
              WHEN k % 100 = 12 THEN '99' || lpad(CAST(k AS VARCHAR), 10, '0') ELSE CAST(k AS VARCHAR) END AS account_id,
         snapshot_date,
         CAST(CASE
           WHEN k % 4 = 0 AND m >= cm THEN
             CASE WHEN k % 8 = 0 THEN last_day(make_date(2021, cm, 1)) ELSE make_date(2021, cm, 15) END
           WHEN k % 12 = 4 AND cm > 1 AND m = cm - 1 THEN make_date(2021, cm - 1, 20)
         END AS TIMESTAMP) AS churn_ts,
         CAST(CASE WHEN k % 3 = 0 THEN make_date(2021, {_INSTALL_MONTH}, {_DAY})
                   ELSE make_date(2019, CAST(1 + k % 12 AS INTEGER), {_DAY}) END AS TIMESTAMP)
           + CASE WHEN k % 12 = 0 AND day(snapshot_date) > 10 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS install_ts,
         CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k % 30 + m AS DOUBLE) END AS age_months,
         CASE WHEN k % 5 < 3 OR m > 9 THEN 'BB' || CAST(k % 4 + k % 3 AS VARCHAR) END AS bb_product_id,
         CASE WHEN k % 5 < 3 OR m > 9 THEN 'Internet ' || CAST(k % 4 + k % 3 AS VARCHAR) END AS bb_product_name,
         CASE WHEN k % 3 <> 1 AND NOT (k % 16 = 4 AND day(snapshot_date) <= 10) THEN 'TV' || CAST(k % 3 AS VARCHAR) END
           AS tv_product_id,
         CASE WHEN k % 7 < 4 THEN 'VO' || CAST(k % 2 AS VARCHAR) END AS vo_product_id,
         CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(k % 50 + 0.25 * (m % 3) AS DOUBLE) END AS bb_mrc,
         CAST(CASE WHEN k % 31 = 0 THEN 100 ELSE 0.5 * (k % 3) END AS DOUBLE) AS bb_mrc_discount,
         CAST(k % 20 AS DOUBLE) AS tv_mrc,
         CAST(0.25 * (k % 2) AS DOUBLE) AS tv_mrc_discount,
         CAST(k % 10 AS DOUBLE) AS vo_mrc,
         CAST(0 AS DOUBLE) AS vo_mrc_discount,
         CASE k % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN '12d' WHEN 3 THEN '5f' WHEN 4 THEN '1e3' WHEN 5 THEN ' 7 '
              WHEN 6 THEN '' ELSE CAST(k % 10 AS VARCHAR) END AS vo_billed_raw,
         CAST(k % 50 - 0.5 * (m % 4) AS DOUBLE) AS bb_billed,
         CAST(k % 20 AS DOUBLE) AS tv_billed,
         {_PAD} || CASE WHEN nk = 7 AND k % 2 = 1 THEN 'SAN JOSÉ ' ELSE 'SAN JOSE ' END || CAST(nk AS VARCHAR) || '-'
           || CAST(k % 6 AS VARCHAR) || {_PAD} AS district_code,
         'CANTON ' || CAST(nk % 10 AS VARCHAR) || ' ' AS canton_code,
         ' REGION ' || CAST(nk % 5 AS VARCHAR) AS province_code
  FROM crm_rows_made
  WHERE NOT (k % 4 = 0 AND m > cm)
),
service_orders AS (
  SELECT CAST(o_custkey AS VARCHAR) AS contract_id,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE make_date(2021,
           CAST(CASE WHEN {_QUIT} THEN greatest(1, {_CHURN_MONTH.format(k='o_custkey')} - o_orderkey % 5)
                     ELSE month(o_orderdate) END AS INTEGER),
           CAST(CASE WHEN {_QUIT} AND o_orderkey % 2 = 0 THEN 1 + o_custkey % 14
                     ELSE least(day(o_orderdate), 28) END AS INTEGER)) END AS opened_on,
         CASE WHEN {_QUIT} THEN 'DESINSTALACION' ELSE 'INSTALACION' END AS order_type,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'CANCELADA'
              ELSE 'FINALIZADA' END AS status,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'MOROSIDAD'
              ELSE 'COMPETENCIA' END AS sub_reason
  FROM orders
),
activations AS (
  SELECT CAST(c_custkey AS VARCHAR) AS contract_id,
         make_date(2021, {_INSTALL_MONTH}, {_DAY}) AS sold_on,
         c_mktsegment AS channel,
         CASE WHEN c_custkey % 10 = 9 THEN 'Migracion' ELSE 'Nueva' END AS sale_type,
         CASE c_custkey % 5 WHEN 0 THEN 'RESIDENCIAL' WHEN 1 THEN 'EMPLEADO'
              WHEN 2 THEN 'PROGRAMA HOGARES CONECTADOS' WHEN 3 THEN 'RESIDENCIAL' ELSE 'PYMES' END AS customer_type,
         CASE WHEN c_custkey % 11 = 10 THEN 'Bajas' ELSE 'Altas por venta' END AS movement_type,
         CASE WHEN c_custkey % 2 = 0 THEN 'VENTA' ELSE 'VENTA NUEVA ' END AS reason,
         CASE WHEN c_custkey % 8 = 3 THEN 'INBOUND PYMES' ELSE 'TIENDA' END AS subchannel
  FROM customer
),
speed_inventory AS (
  SELECT CASE WHEN c_custkey % 10 = 9 THEN 'none-' ELSE '' END || CAST(c_custkey AS VARCHAR) AS contract_id,
         CAST(50 * (1 + c_custkey % 6) AS VARCHAR) || ' Mbps' AS speed_range
  FROM customer
),
district_index AS (
  SELECT 'Región ' || CAST(n_regionkey AS VARCHAR) AS province,
         'Cantón ' || CAST(n_nationkey % 10 AS VARCHAR) AS canton,
         CASE WHEN n_nationkey % 6 = 5 THEN 'Sin cliente ' WHEN n_nationkey = 7 THEN 'San JosÉ ' ELSE 'San José ' END
           || CAST(n_nationkey AS VARCHAR) || '-' || CAST(part AS VARCHAR) AS district,
         CASE WHEN n_nationkey % 6 = 4 THEN NULL ELSE 'E' || CAST(n_nationkey % 4 AS VARCHAR) END AS economic_band,
         CAST(0.5 * n_nationkey AS DOUBLE) AS ids_2017
  FROM nation, (SELECT unnest(range(6)) AS part), (SELECT unnest([1, 2]) AS twice)
  WHERE twice = 1 OR n_nationkey = 3
)"""
