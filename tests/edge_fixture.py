"""Hand-made edge fixture for the churn core and the traps of SURVEY §2.13.

Rows E1-E10 follow FIXTURES.md §3 (with its hand-derived G08 and P01
answers); E11-E17 add the cases it lists as still to hand-make. The same rows
are loaded into Spark (declared schemas) and DuckDB (Arrow tables of the
same types), so every registered query can also be compared with the oracle
SQL on them.
"""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from subscope.sources import schema as S
from subscope.sources.tables import Tables

D = dt.date
TS = dt.datetime

BB = {"bb_product_id": "BB1", "bb_product_name": "Internet 1"}
TV = {"tv_product_id": "TV1"}

CRM_DEFAULT = dict(
    account_id=None, snapshot_date=None, churn_ts=None, install_ts=TS(2019, 1, 1), age_months=10.0,
    bb_product_id=None, bb_product_name=None, tv_product_id=None, vo_product_id=None,
    bb_mrc=10.0, bb_mrc_discount=0.0, tv_mrc=5.0, tv_mrc_discount=0.0, vo_mrc=0.0, vo_mrc_discount=0.0,
    vo_billed_raw="1", bb_billed=10.0, tv_billed=5.0,
    district_code="SAN JOSE 1", canton_code="CANTON 1", province_code="REGION 1",
)


def crm(acct, snap, churn=None, products=None, **kw):
    row = dict(CRM_DEFAULT)
    row.update(account_id=acct, snapshot_date=snap, churn_ts=None if churn is None else TS(churn.year, churn.month, churn.day))
    row.update(products or {})
    row.update(kw)
    return row


def order(contract, opened, status="FINALIZADA", reason="PRECIO", order_type="DESINSTALACION"):
    return dict(contract_id=contract, opened_on=opened, order_type=order_type, status=status, sub_reason=reason)


CRM_ROWS = [
    # Month difference exactly 3 -> involuntary
    crm("1", D(2021, 4, 30), D(2021, 4, 30), BB),
    # Calendar difference 4 though under 100 days -> out
    crm("2", D(2021, 5, 31), D(2021, 5, 10), {**BB, **TV}),
    # Same-day order, no product (NULL bundle); installed on its sale day
    crm("3", D(2021, 5, 31), D(2021, 5, 10), install_ts=TS(2021, 2, 1, 9, 30)),
    # First churn in 2020 -> out
    crm("4", D(2021, 6, 30), D(2020, 6, 15), BB),
    # E5: last churn month (7) differs from last snapshot month (8) -> out
    crm("5", D(2021, 8, 31), D(2021, 7, 15), BB),
    # Cancelled order still counts
    crm("6", D(2021, 5, 31), D(2021, 5, 10), BB),
    # Tied first-day orders with two reasons (T9), two bundles on the churn date
    crm("7", D(2021, 5, 31), D(2021, 5, 10), BB),
    crm("7", D(2021, 5, 10), D(2021, 5, 10), TV),
    # NULL status dropped
    crm("8", D(2021, 5, 31), D(2021, 5, 10), BB),
    # Long raw id keeps its rightmost 10 characters (T1); NULL reason
    crm("990000000009", D(2021, 5, 31), D(2021, 5, 10), BB),
    # Order after the churn -> out
    crm("10", D(2021, 5, 31), D(2021, 5, 10), BB),
    # E7-like tie whose last snapshot equals its churn date (P11 counts it twice)
    crm("11", D(2021, 4, 30), None, BB, district_code="SAN JOSE 3", canton_code="CANTON 3", province_code="REGION 1"),
    crm("11", D(2021, 5, 10), D(2021, 5, 10), BB, district_code="SAN JOSE 3", canton_code="CANTON 3",
        province_code="REGION 1"),
    # Two raw spellings of one contract
    crm("12", D(2021, 5, 31), D(2021, 5, 10), BB),
    crm("0000000012", D(2021, 3, 31), D(2021, 3, 5), TV),
    # District code stored with and without blanks
    crm("13", D(2021, 4, 30), None, BB, district_code=" SAN JOSE 2 ", canton_code="CANTON 2 ",
        province_code=" REGION 1"),
    crm("13", D(2021, 5, 31), None, BB, district_code="SAN JOSE 2", canton_code="CANTON 2", province_code="REGION 1"),
    # Two install timestamps on one day (G21 counts both)
    crm("14", D(2021, 3, 10), None, BB, install_ts=TS(2021, 3, 5, 8, 0)),
    crm("14", D(2021, 3, 31), None, BB, install_ts=TS(2021, 3, 5, 17, 0)),
    # August churner located in a catalogue district (district reports)
    crm("15", D(2021, 8, 10), None, BB, age_months=5.0),
    crm("15", D(2021, 8, 31), D(2021, 8, 20), BB, age_months=30.0),
    # Revenue trend account: month ends May-Jul, two tenure bands in August
    # (T16), a NULL broadband bill and a zero base
    crm("16", D(2021, 5, 31), None, BB, bb_mrc=0.0, tv_mrc=0.0, age_months=2.0),
    crm("16", D(2021, 6, 30), None, BB, bb_mrc=12.5, age_months=2.0, bb_billed=None),
    crm("16", D(2021, 7, 31), None, BB, bb_mrc=12.5, age_months=2.0, vo_billed_raw="N/A"),
    crm("16", D(2021, 8, 10), None, BB, age_months=3.0),
    crm("16", D(2021, 8, 31), None, BB, age_months=4.0),
    # October churner with tenure, and a catalogue name with an upper-case accent
    crm("17", D(2021, 10, 31), D(2021, 10, 5), {**BB, **TV, "vo_product_id": "VO1"}, age_months=13.0,
        district_code="AVILA", canton_code="CANTON 9", province_code="REGION 2"),
    # Texts that only look like numbers, and white space other than blanks around a location
    crm("18", D(2021, 5, 10), None, BB, vo_billed_raw="12d", district_code="SAN JOSE 1\t", canton_code="\u00a0CANTON 1",
        province_code="REGION 1\u2003"),
    crm("18", D(2021, 8, 10), None, BB, vo_billed_raw="5f", district_code="SAN JOSE 1\u00a0"),
    crm("18", D(2021, 8, 31), None, BB, vo_billed_raw="1e3"),
    crm("18", D(2021, 9, 10), None, BB, vo_billed_raw=" 7 "),
    crm("18", D(2021, 9, 30), None, BB, vo_billed_raw=""),
    # An August churner whose district carries a tab
    crm("19", D(2021, 8, 31), D(2021, 8, 20), BB, district_code="\tSAN JOSE 1"),
]

ORDER_ROWS = [
    order("1", D(2021, 1, 1), reason="MOROSIDAD"),
    order("2", D(2021, 1, 31), reason="MOROSIDAD"),
    order("3", D(2021, 5, 10)),
    order("4", D(2021, 4, 1)),
    order("5", D(2021, 6, 1)),
    order("6", D(2021, 4, 1), status="CANCELADA"),
    order("7", D(2021, 4, 1)),
    order("7", D(2021, 4, 1), reason="MOROSIDAD"),
    order("7", D(2021, 4, 2), reason="X"),
    order("8", D(2021, 4, 1), status=None),
    order("0000000009", D(2021, 4, 1), reason=None),
    order("10", D(2021, 5, 11)),
    order("11", D(2021, 4, 1)),
    order("11", D(2021, 4, 1), reason="MOROSIDAD"),
    order("12", D(2021, 2, 1)),
    order("15", D(2021, 7, 1)),
    order("15", D(2021, 7, 1), order_type="INSTALACION"),
    order("17", D(2021, 9, 1), reason="MOROSIDAD"),
    order("17", None),
    order("19", D(2021, 8, 1)),
]


def sale(contract, sold, channel="TIENDA", sale_type="Nueva", customer_type="RESIDENCIAL",
         movement="Altas por venta", reason="VENTA NUEVA ", subchannel="TIENDA"):
    return dict(contract_id=contract, sold_on=sold, channel=channel, sale_type=sale_type, customer_type=customer_type,
                movement_type=movement, reason=reason, subchannel=subchannel)


ACTIVATION_ROWS = [
    sale("3", D(2021, 2, 1)),
    sale("14", D(2021, 3, 5), channel="WEB", reason="VENTA"),
    sale("14", D(2021, 3, 5), channel="WEB", reason="VENTA"),
    sale("6", D(2021, 1, 5), customer_type="PYMES"),
    sale("7", D(2021, 1, 5), reason="VENTA NUEVA"),  # no trailing blank: filtered out
    sale("16", D(2021, 4, 1), channel="WEB"),
]

SPEED_ROWS = [
    dict(contract_id="1", speed_range="50 Mbps"),
    dict(contract_id="0000000006", speed_range="100 Mbps"),
    dict(contract_id="7", speed_range="100 Mbps"),
    dict(contract_id="16", speed_range="50 Mbps"),
    dict(contract_id="16", speed_range="50 Mbps"),
]

DISTRICT_ROWS = [
    dict(province="Región 1", canton="Cantón 1", district="San José 1", economic_band="E1", ids_2017=1.5),
    dict(province="Región 1", canton="Cantón 2", district="San José 2", economic_band=None, ids_2017=2.0),
    dict(province="Región 1", canton="Cantón 3", district="San José 3", economic_band="E3", ids_2017=3.0),
    # same district name in another canton
    dict(province="Región 1", canton="Cantón 4", district="San José 3", economic_band="E4", ids_2017=4.0),
    # upper-case accent survives folding
    dict(province="Región 2", canton="Cantón 9", district="Ávila", economic_band="E2", ids_2017=9.0),
]

_ARROW = {T.StringType(): pa.string(), T.DateType(): pa.date32(), T.TimestampNTZType(): pa.timestamp("us"),
          T.DoubleType(): pa.float64()}

TABLE_ROWS = {
    "crm_snapshots": CRM_ROWS,
    "service_orders": ORDER_ROWS,
    "activations": ACTIVATION_ROWS,
    "speed_inventory": SPEED_ROWS,
    "district_index": DISTRICT_ROWS,
}


def tables_from_rows(spark: SparkSession, table_rows: dict) -> Tables:
    def df(name):
        schema = S.SCHEMAS[name]
        return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in table_rows[name]], schema)

    return Tables(df("crm_snapshots"), df("service_orders"), df("activations"), df("speed_inventory"),
                  df("district_index"))


def register_rows(con, table_rows: dict) -> None:
    for name, rows in table_rows.items():
        schema = S.SCHEMAS[name]
        arrow_schema = pa.schema([pa.field(f.name, _ARROW[f.dataType]) for f in schema.fields])
        cols = {f.name: [r[f.name] for r in rows] for f in schema.fields}
        con.register(name, pa.table(cols, schema=arrow_schema))


def edge_tables(spark: SparkSession) -> Tables:
    return tables_from_rows(spark, TABLE_ROWS)


def register_duckdb(con) -> None:
    register_rows(con, TABLE_ROWS)
