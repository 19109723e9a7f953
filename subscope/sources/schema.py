"""Declared schemas of the five canonical input tables.

Reading with a declared schema (never ``inferSchema``) makes a type drift in
the warehouse export fail at load instead of silently changing results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Churn and install times are wall-clock date-times (no time zone): DATE(ts)
# and the values a client reads back do not depend on any session or
# process time zone.
S, D, TS, DBL = T.StringType(), T.DateType(), T.TimestampNTZType(), T.DoubleType()


def _struct(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


CRM_SNAPSHOTS = _struct(
    ("account_id", S, False),
    ("snapshot_date", D, False),
    ("churn_ts", TS, True),
    ("install_ts", TS, True),
    ("age_months", DBL, True),
    ("bb_product_id", S, True),
    ("bb_product_name", S, True),
    ("tv_product_id", S, True),
    ("vo_product_id", S, True),
    ("bb_mrc", DBL, True),
    ("bb_mrc_discount", DBL, True),
    ("tv_mrc", DBL, True),
    ("tv_mrc_discount", DBL, True),
    ("vo_mrc", DBL, True),
    ("vo_mrc_discount", DBL, True),
    ("vo_billed_raw", S, True),
    ("bb_billed", DBL, True),
    ("tv_billed", DBL, True),
    ("district_code", S, True),
    ("canton_code", S, True),
    ("province_code", S, True),
)

SERVICE_ORDERS = _struct(
    ("contract_id", S, True),
    ("opened_on", D, True),
    ("order_type", S, True),
    ("status", S, True),
    ("sub_reason", S, True),
)

ACTIVATIONS = _struct(
    ("contract_id", S, True),
    ("sold_on", D, True),
    ("channel", S, True),
    ("sale_type", S, True),
    ("customer_type", S, True),
    ("movement_type", S, True),
    ("reason", S, True),
    ("subchannel", S, True),
)

SPEED_INVENTORY = _struct(
    ("contract_id", S, True),
    ("speed_range", S, True),
)

DISTRICT_INDEX = _struct(
    ("province", S, True),
    ("canton", S, True),
    ("district", S, True),
    ("economic_band", S, True),
    ("ids_2017", DBL, True),
)

SCHEMAS = {
    "crm_snapshots": CRM_SNAPSHOTS,
    "service_orders": SERVICE_ORDERS,
    "activations": ACTIVATIONS,
    "speed_inventory": SPEED_INVENTORY,
    "district_index": DISTRICT_INDEX,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: every declared column must exist and
    have a type castable without loss of meaning; extra columns are dropped
    (column pruning then keeps them out of the scan)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; have {sorted(have)}")
    return df.selectExpr(*[
        f"`{f.name}`" if have[f.name] == f.dataType else f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields])
