"""The CRM table as a history of mergeable facts, kept by increments.

Churn, bundle, place and cohort reports ask the CRM table for least and
greatest dates, greatest ages and distinct values only. One row per account,
month, churn time, install time, owned products and (raw) place, with the
last snapshot date and the greatest age among its snapshots, holds all of it:
an account with daily snapshots that does not change has one row a month.
Every fact is a maximum over a key, so histories merge: a new snapshot date
costs a read of that date and of its month's history, not of the CRM.

A stored history is partitioned by month. :func:`add_snapshots` merges new
dates; adding a date twice changes nothing. A maximum cannot be taken back,
so a date whose rows were corrected or withdrawn goes through
:func:`replay_dates`, which rebuilds the months of those dates from the CRM.
:func:`as_crm` gives the history as CRM rows, and the reports in
``HISTORY_REPORTS`` return on them what they return on the CRM table.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subscope.functions import exprs as X
from subscope.operators.churn import LOCATION

KEY = ["account_id", "month", "churn_ts", "install_ts", "owned", *LOCATION]

HISTORY = T.StructType([
    T.StructField("account_id", T.StringType()), T.StructField("churn_ts", T.TimestampNTZType()),
    T.StructField("install_ts", T.TimestampNTZType()), T.StructField("owned", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in LOCATION],
    T.StructField("last_snapshot", T.DateType()), T.StructField("max_age", T.DoubleType()),
    T.StructField("month", T.DateType()),
])

# Reports that take only least / greatest dates, greatest ages within a month
# and distinct values from the CRM table. The others need each date's age
# (P09), charges (P04, P05) or no CRM rows at all.
HISTORY_REPORTS = (
    "bundle_churners_by_month", "bundle_active_tenure", "bundle_churner_tenure", "district_churners",
    "district_churners_tenure", "district_churners_ids", "district_active_economic_by_month", "district_churn_rate",
    "district_churn_rate_by_month", "district_catalog_coverage", "new_sales_by_channel", "new_sales_churners_by_channel",
)

_OWNED = {"bb_product_id": 4, "tv_product_id": 2, "vo_product_id": 1}

# Rows that one task groups. A row takes some 230 bytes of each hash table
# that it passes, up to six in the merge of two histories.
ROWS_A_TASK = 250_000


def tasks_for(*rows: DataFrame) -> int:
    """How many tasks group these rows, whatever the table's size: as many as
    there are cores, or more to keep to ``ROWS_A_TASK``. The rows are counted,
    for stored tables in the footers of the files."""
    return tasks_of(rows[0].sparkSession, sum(r.count() for r in rows))


def tasks_of(spark: SparkSession, rows: int) -> int:
    """:func:`tasks_for` rows that were counted before."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_TASK))


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows of a history dealt by key. The number holds: adaptive execution
    merges the partitions that it makes itself up to 64 MB of compressed rows,
    which are over 1 GB in the hash tables of a merge."""
    return rows.repartition(tasks, *KEY)


def merged(rows: DataFrame) -> DataFrame:
    """Rows of one or several histories (a union) as one. Histories that are
    :func:`dealt` to the same number of tasks are merged where they are."""
    return rows.groupBy(*KEY).agg(F.max("last_snapshot").alias("last_snapshot"), F.max("max_age").alias("max_age"))


def history_of(crm: DataFrame, tasks: int | None = None) -> DataFrame:
    """The history of CRM rows: one groupBy keyed by account and month, in
    ``tasks`` tasks (counted, if not given)."""
    rows = crm.selectExpr(
        "account_id", "trunc(snapshot_date, 'MM') AS month", "churn_ts", "install_ts", f"{X.BUNDLE_CODE} AS owned",
        *LOCATION, "snapshot_date AS last_snapshot", "age_months AS max_age")
    return merged(dealt(rows, tasks_for(crm) if tasks is None else tasks))


def as_crm(history: DataFrame) -> DataFrame:
    """A history as CRM rows for the reports in ``HISTORY_REPORTS``. Columns
    that a history does not hold are missing, so a report that needs one
    fails; product columns tell only whether there is a product."""
    products = [f"CASE WHEN owned & {bit} != 0 THEN 'owned' END AS {name}" for name, bit in _OWNED.items()]
    return history.selectExpr("account_id", "last_snapshot AS snapshot_date", "churn_ts", "install_ts",
                              "max_age AS age_months", *products, *LOCATION)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The stored history. Read it anew after an update: a DataFrame made
    before keeps the list of files that the update replaced."""
    return spark.read.schema(HISTORY).parquet(root).where("account_id IS NOT NULL")


def add_snapshots(spark: SparkSession, root: str, crm: DataFrame) -> list[dt.date]:
    """Merge CRM rows of new snapshot dates into the history at ``root``
    (made if there is none) and return the months that were written."""
    months = [r.month for r in crm.selectExpr("trunc(snapshot_date, 'MM') AS month").distinct().collect()]
    if not months:
        return []
    try:
        held = read_history(spark, root).where(F.col("month").isin(months))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new = history_of(crm)
    else:
        tasks = tasks_for(crm, held)
        new = merged(history_of(crm, tasks).unionByName(dealt(held, tasks)))
    return _write(spark, root, new, months)


def replay_dates(spark: SparkSession, root: str, crm: DataFrame, dates: Iterable[dt.date]) -> list[dt.date]:
    """Rebuild the months of ``dates`` from the (corrected) CRM table, of
    which only the snapshot dates in these months are read. A month that has
    no rows left has none in the history either."""
    months = sorted({d.replace(day=1) for d in dates})
    if not months:
        return []
    ends = [(m.replace(day=28) + dt.timedelta(days=4)).replace(day=1) for m in months]
    within = " OR ".join(f"(snapshot_date >= DATE'{a}' AND snapshot_date < DATE'{b}')" for a, b in zip(months, ends))
    return _write(spark, root, history_of(crm.where(within)), months)


def _write(spark: SparkSession, root: str, history: DataFrame, months: list[dt.date]) -> list[dt.date]:
    """Replace the given months. Tasks write to a staging folder while the old
    files can still be read, and the months are exchanged when all are done,
    so lost executors do no harm; if the driver is lost during the exchange,
    :func:`replay_dates` of these months mends the history. A row without an
    account is written for each month, so that an empty one is exchanged too.
    """
    marks = spark.createDataFrame([(m,) for m in months], "month date")
    rows = history.hint("rebalance", "month").unionByName(marks, allowMissingColumns=True)
    rows.select(*HISTORY.fieldNames()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "month").parquet(root)
    return sorted(months)
