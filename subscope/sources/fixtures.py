"""Canonical tables derived from the driver's TPC-H-like test data.

Deterministic, integer arithmetic only; amounts are multiples of 0.25 so they
are exact in binary. The same mapping is written once more as a DuckDB CTE
prelude in :mod:`subscope.oracle` (see FIXTURES.md §2).

Every table is a lazy view over the parquet files, so the work grows with
the input: ``crm_snapshots`` is generated per customer row (no cross join),
the others are per-row projections. A table is built when it is first asked
for, and its columns are SQL text, which Spark parses in one call.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from subscope.sources import schema as S
from subscope.sources.tables import Tables


def _churn_month(k: str) -> str:
    """Half of the churners in August or October, the others spread."""
    q = f"floor({k} / 4)"
    return f"CAST(CASE {q} % 4 WHEN 0 THEN 8 WHEN 1 THEN 10 ELSE 1 + ({q} * 7) % 12 END AS INT)"


def _install_month(k: str) -> str:
    return f"(1 + CAST(floor({k} / 12) AS INT) % 6)"


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


CRM = {
    # two spellings of one contract; an id longer than the padded key
    "account_id": "CASE WHEN k % 100 = 8 AND m > 6 THEN padded WHEN k % 100 = 12 THEN concat('99', padded) "
                  "ELSE CAST(k AS STRING) END",
    "snapshot_date": "snapshot_date",
    "churn_ts": "CAST(CASE WHEN k % 4 = 0 AND m >= cm THEN "
                "if(k % 8 = 0, last_day(make_date(2021, cm, 1)), make_date(2021, cm, 15)) "
                "WHEN k % 12 = 4 AND cm > 1 AND m = cm - 1 THEN make_date(2021, cm - 1, 20) END AS TIMESTAMP_NTZ)",
    # a second install time on the same day
    "install_ts": f"CAST(if(k % 3 = 0, make_date(2021, {_install_month('k')}, CAST(1 + k % 28 AS INT)), "
                  "make_date(2019, CAST(1 + k % 12 AS INT), CAST(1 + k % 28 AS INT))) AS TIMESTAMP_NTZ) "
                  "+ if(k % 12 = 0 AND at_end, INTERVAL '5' HOUR, INTERVAL '0' HOUR)",
    "age_months": "CAST(if(k % 17 = 0, NULL, k % 30 + m) AS DOUBLE)",
    "bb_product_id": "if(has_bb, concat('BB', CAST(k % 4 + k % 3 AS STRING)), NULL)",
    "bb_product_name": "if(has_bb, concat('Internet ', CAST(k % 4 + k % 3 AS STRING)), NULL)",
    # the bundle changes between the two snapshots of the churn month
    "tv_product_id": "if(k % 3 != 1 AND NOT (k % 16 = 4 AND NOT at_end), concat('TV', CAST(k % 3 AS STRING)), NULL)",
    "vo_product_id": "if(k % 7 < 4, concat('VO', CAST(k % 2 AS STRING)), NULL)",
    "bb_mrc": "CAST(if(k % 23 = 0, NULL, k % 50 + 0.25D * (m % 3)) AS DOUBLE)",
    # negative net charges
    "bb_mrc_discount": "if(k % 31 = 0, 100.0D, 0.5D * (k % 3))",
    "tv_mrc": "CAST(k % 20 AS DOUBLE)",
    "tv_mrc_discount": "0.25D * (k % 2)",
    "vo_mrc": "CAST(k % 10 AS DOUBLE)",
    "vo_mrc_discount": "0.0D",
    "vo_billed_raw": "CASE k % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN '12d' WHEN 3 THEN '5f' WHEN 4 THEN '1e3' "
                     "WHEN 5 THEN ' 7 ' WHEN 6 THEN '' ELSE CAST(k % 10 AS STRING) END",
    "bb_billed": "k % 50 - 0.5D * (m % 4)",
    "tv_billed": "CAST(k % 20 AS DOUBLE)",
    # the catalogue's name of nation 7 has an upper-case accent, and so have some codes
    "district_code": "concat(pad, if(nk = 7 AND k % 2 = 1, 'SAN JOS\u00c9 ', 'SAN JOSE '), CAST(nk AS STRING), '-', "
                     "CAST(k % 6 AS STRING), pad)",
    "canton_code": "concat('CANTON ', CAST(nk % 10 AS STRING), ' ')",
    "province_code": "concat(' REGION ', CAST(nk % 5 AS STRING))",
}


# customers whose snapshots one task makes
CUSTOMERS_A_TASK = 16_000


def crm_from_customer(customer: DataFrame) -> DataFrame:
    """Two snapshots a month of every customer. The customers (two numbers
    each) are dealt over all cores first, or over more tasks if they are many
    (counted in the file's footer): a customer makes 24 wide rows, and a file
    of one row group would make them in one task."""
    tasks = max(customer.sparkSession.sparkContext.defaultParallelism, math.ceil(customer.count() / CUSTOMERS_A_TASK))
    months = customer.select("c_custkey", "c_nationkey").repartition(tasks).selectExpr(
        "c_custkey AS k", "c_nationkey", f"{_churn_month('c_custkey')} AS cm", "explode(sequence(1, 12)) AS m",
    ).where("NOT (k % 4 = 0 AND m > cm)")
    rows = months.selectExpr(
        "*", "explode(array(make_date(2021, m, 10), last_day(make_date(2021, m, 1)))) AS snapshot_date"
    ).selectExpr(
        "k", "m", "cm", "snapshot_date",
        # a move to the next nation after March (some accounts)
        "if(k % 28 = 4 AND m > 3, (c_nationkey + 1) % 25, c_nationkey) AS nk",
        "dayofmonth(snapshot_date) > 10 AS at_end",
        "k % 5 < 3 OR m > 9 AS has_bb",
        "CASE WHEN k % 6 = 2 THEN '\t\u00a0' WHEN k % 2 = 0 THEN ' ' ELSE '' END AS pad",
        "lpad(CAST(k AS STRING), 10, '0') AS padded",
    )
    return S.conform(rows.selectExpr(*_named(CRM)), S.CRM_SNAPSHOTS)


_QUIT = "(o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"
ORDERS = {
    "contract_id": "CAST(o_custkey AS STRING)",
    # disconnect orders 0 to 4 months before the churn month, with ties on one day
    "opened_on": f"if(o_orderkey % 13 = 0, NULL, make_date(2021, if({_QUIT}, "
                 f"greatest(1, {_churn_month('o_custkey')} - CAST(o_orderkey % 5 AS INT)), month(o_orderdate)), "
                 f"if({_QUIT} AND o_orderkey % 2 = 0, CAST(1 + o_custkey % 14 AS INT), least(dayofmonth(o_orderdate), 28))))",
    "order_type": f"if({_QUIT}, 'DESINSTALACION', 'INSTALACION')",
    "status": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'CANCELADA' "
              "ELSE 'FINALIZADA' END",
    "sub_reason": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'MOROSIDAD' ELSE 'COMPETENCIA' END",
}


def orders_from_orders(orders: DataFrame) -> DataFrame:
    return S.conform(orders.selectExpr(*_named(ORDERS)), S.SERVICE_ORDERS)


ACTIVATIONS = {
    "contract_id": "CAST(c_custkey AS STRING)",
    "sold_on": f"make_date(2021, {_install_month('c_custkey')}, CAST(1 + c_custkey % 28 AS INT))",
    "channel": "c_mktsegment",
    "sale_type": "if(c_custkey % 10 = 9, 'Migracion', 'Nueva')",
    "customer_type": "CASE c_custkey % 5 WHEN 1 THEN 'EMPLEADO' WHEN 2 THEN 'PROGRAMA HOGARES CONECTADOS' "
                     "WHEN 4 THEN 'PYMES' ELSE 'RESIDENCIAL' END",
    "movement_type": "if(c_custkey % 11 = 10, 'Bajas', 'Altas por venta')",
    "reason": "if(c_custkey % 2 = 0, 'VENTA', 'VENTA NUEVA ')",
    "subchannel": "if(c_custkey % 8 = 3, 'INBOUND PYMES', 'TIENDA')",
}


def activations_from_customer(customer: DataFrame) -> DataFrame:
    return S.conform(customer.selectExpr(*_named(ACTIVATIONS)), S.ACTIVATIONS)


SPEEDS = {
    # every tenth matches nothing
    "contract_id": "if(c_custkey % 10 = 9, concat('none-', CAST(c_custkey AS STRING)), CAST(c_custkey AS STRING))",
    "speed_range": "concat(CAST(50 * (1 + c_custkey % 6) AS STRING), ' Mbps')",
}


def speeds_from_customer(customer: DataFrame) -> DataFrame:
    return S.conform(customer.selectExpr(*_named(SPEEDS)), S.SPEED_INVENTORY)


DISTRICTS = {
    "province": "concat('Regi\u00f3n ', CAST(n_regionkey AS STRING))",
    "canton": "concat('Cant\u00f3n ', CAST(nk % 10 AS STRING))",
    "district": "concat(CASE WHEN nk % 6 = 5 THEN 'Sin cliente ' WHEN nk = 7 THEN 'San Jos\u00c9 ' ELSE 'San Jos\u00e9 ' END, "
                "CAST(nk AS STRING), '-', CAST(part AS STRING))",
    "economic_band": "if(nk % 6 = 4, NULL, concat('E', CAST(nk % 4 AS STRING)))",
    "ids_2017": "0.5D * nk",
}


def districts_from_nation(nation: DataFrame) -> DataFrame:
    """Six districts a nation; those of every sixth nation match no code,
    and nation 3 is listed twice."""
    rows = nation.selectExpr("n_nationkey AS nk", "n_regionkey", "explode(sequence(0, 5)) AS part").selectExpr(
        "*", "explode(if(nk = 3, array(1, 2), array(1))) AS copy")
    return S.conform(rows.selectExpr(*_named(DISTRICTS)), S.DISTRICT_INDEX)


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The five canonical tables as lazy views over ``sf_dir``'s parquet;
    files are opened for the tables that a report uses."""

    def made(make, name: str) -> DataFrame:
        return make(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    return Tables(
        crm=partial(made, crm_from_customer, "customer"),
        orders=partial(made, orders_from_orders, "orders"),
        activations=partial(made, activations_from_customer, "customer"),
        speeds=partial(made, speeds_from_customer, "customer"),
        districts=partial(made, districts_from_nation, "nation"),
    )
