"""Active contracts by bundle and tenure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.functions import exprs as X

_SLOTS = list(X.BUNDLE_BY_CODE.items())  # (owned-products code, label)


def last_snapshot_bundles(crm: DataFrame) -> DataFrame:
    """Per (raw account, month number) the bundle label(s) seen on the
    account-month's last snapshot, with the maximum age of all the month's
    rows under that label and the label's last snapshot date.

    One groupBy on (account, month) computes, for each of the eight bundle
    slots, the slot's last snapshot and maximum age as conditional
    aggregates; a stack then keeps the slots whose last snapshot equals the
    account-month's last snapshot. This replaces aggregate + self-join +
    HAVING, and never gathers more than one partial row per account-month
    and task.
    """
    aggs = [F.max("snapshot_date").alias("month_last")]
    for i, _ in _SLOTS:
        cond = F.col("bcode") == i
        aggs.append(F.max(F.when(cond, F.col("snapshot_date"))).alias(f"d_{i}"))
        aggs.append(F.max(F.when(cond, F.col("age_months"))).alias(f"a_{i}"))
    rows = crm.withColumn("bcode", X.bundle_code())
    g = rows.groupBy("account_id", F.month("snapshot_date").alias("month")).agg(*aggs)
    pairs = ", ".join(
        f"{X.quoted(label)}, d_{i}, a_{i}" for i, label in _SLOTS
    )
    return g.selectExpr(
        "account_id", "month", "month_last", f"stack({len(_SLOTS)}, {pairs}) AS (bundle, bundle_last, max_age)"
    ).where(F.col("bundle_last") == F.col("month_last"))

