"""Recurring-charge trend of retained customers.

Scale notes: the month tables are bounded by the parameter lists (at most
one row per requested month), so they are broadcast. The report itself
(:func:`non_churner_charge_evolution`) is one per-account aggregate over a
union of pruned CRM slices; the literal-grain segments G24-G27 are kept as
separate functions (anti join, fan-out join) for their own queries.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.operators.joins import bounded_broadcast
from subscope.params import ReportParams


def _add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.month - 1 + n, 12)
    return dt.date(d.year + y, m + 1, 1)


def _month_end(d: dt.date) -> dt.date:
    return _add_months(d, 1) - dt.timedelta(days=1)


def static_window(p: ReportParams) -> tuple[dt.date, dt.date]:
    """Snapshot-date range that can matter at all: from the first analysis
    month to the end of the churn horizon. The data-driven bounds below always
    lie inside it, so filtering on it first is exact and lets the scan prune
    partitions / row groups."""
    lo = min(p.analysis_months)
    hi = _month_end(_add_months(max(p.analysis_months), p.churn_horizon_months))
    return lo, hi


def analysis_month_order(crm: DataFrame, p: ReportParams) -> DataFrame:
    """Requested analysis months that occur in the data, numbered in
    calendar order (a missing month shifts the numbering).

    The window has no partition key on purpose: its input has at most
    ``len(p.analysis_months)`` rows."""
    lo, hi = min(p.analysis_months), _month_end(max(p.analysis_months))
    present = (
        crm.where(F.col("snapshot_date").between(F.lit(lo), F.lit(hi)))
        .select(X.month_start("snapshot_date").alias("month"))
        .where(F.col("month").isin(*p.analysis_months))
        .distinct()
    )
    return present.withColumn("month_order", F.row_number().over(Window.orderBy("month")))


@dataclass(frozen=True)
class MonthBounds:
    """Scalar-subquery Columns: first and last analysis month present, and
    the last month + horizon. Spark evaluates the subquery once and uses the
    values as constants (no join)."""

    first_month: Column
    last_month: Column
    horizon_end: Column


def month_bounds(month_order: DataFrame, p: ReportParams) -> MonthBounds:
    b = month_order.select(F.struct(F.min("month").alias("lo"), F.max("month").alias("hi"))).scalar()
    return MonthBounds(b.getField("lo"), b.getField("hi"), F.add_months(b.getField("hi"), p.churn_horizon_months))


def churn_month_filter(crm: DataFrame, bounds: MonthBounds) -> DataFrame:
    """Accounts whose month-truncated last churn passes the month test
    (T4) and falls between the last analysis month and the horizon."""
    g = crm.groupBy("account_id").agg(
        X.month_start(F.max("churn_ts")).alias("churn_month"), F.max("snapshot_date").alias("last_snapshot")
    ).where(F.month("churn_month") == F.month("last_snapshot"))
    return g.where(F.col("churn_month").between(bounds.last_month, bounds.horizon_end)).select(
        "account_id", "churn_month"
    )


def month_last_snapshot(crm: DataFrame, bounds: MonthBounds, p: ReportParams) -> DataFrame:
    """The table-wide last snapshot date of every month from the first
    analysis month to the horizon end (one row per month)."""
    lo, hi = static_window(p)
    m = crm.where(F.col("snapshot_date").between(F.lit(lo), F.lit(hi))).select(
        "snapshot_date", X.month_start("snapshot_date").alias("month")
    )
    m = m.where(F.col("month").between(bounds.first_month, bounds.horizon_end))
    return m.groupBy("month").agg(F.max("snapshot_date").alias("last_date"))


def active_month_tenure(crm: DataFrame, p: ReportParams) -> DataFrame:
    """Distinct (active month, account, 3-band tenure of the row's age)."""
    lo, hi = min(p.active_months), _month_end(max(p.active_months))
    return (
        crm.where(F.col("snapshot_date").between(F.lit(lo), F.lit(hi)))
        .select(
            X.month_start("snapshot_date").alias("active_month"), "account_id",
            X.tenure_band_3("age_months").alias("tenure"),
        )
        .where(F.col("active_month").isin(*p.active_months))
        .distinct()
    )


def month_end_charges(crm: DataFrame, p: ReportParams) -> DataFrame:
    """CRM rows on their month's last snapshot date, for the analysis months
    present, with the net recurring charge and the billed total in cents."""
    mo = analysis_month_order(crm, p)
    bounds = month_bounds(mo, p)
    last = month_last_snapshot(crm, bounds, p)
    lo, hi = static_window(p)
    rows = crm.where(F.col("snapshot_date").between(F.lit(lo), F.lit(hi)))
    # both month tables have at most one row per month of the parameter range
    j = rows.join(bounded_broadcast(last), rows["snapshot_date"] == last["last_date"]).join(
        bounded_broadcast(mo), "month"
    )
    return j.select(
        "month_order", "account_id", X.net_recurring_charge().alias("mrc_total"),
        X.billed_total().alias("billing_total"),
    )


def account_month_charges(crm: DataFrame, p: ReportParams) -> DataFrame:
    """G27 (literal grain): month-end charge rows of accounts without a
    churn in the horizon, fanned out to every (active month, tenure) of the
    account (T16)."""
    ch = month_end_charges(crm, p)
    churned = churn_month_filter(crm, month_bounds(analysis_month_order(crm, p), p))
    kept = ch.join(churned, "account_id", "left_anti")
    return kept.join(active_month_tenure(crm, p), "account_id").select(
        "month_order", "active_month", "tenure", "account_id", F.col("mrc_total").cast("double").alias("mrc_total"),
        F.col("billing_total").cast("double").alias("billing_total")
    )


def pivot_columns(p: ReportParams) -> list[str]:
    n = len(p.analysis_months)
    return [f"{m}_{k}" for m in ("mrc", "bill") for k in range(1, n + 1)]


def _month_sums(p: ReportParams) -> list:
    """Sum of either amount per month order (a pivot with fixed keys); the
    decimals are summed and cast once."""
    out = []
    for name, col in (("mrc", "mrc_total"), ("bill", "billing_total")):
        for k in range(1, len(p.analysis_months) + 1):
            amount = F.when(F.col("month_order") == k, F.col(col).cast("decimal(18,2)"))
            out.append(F.sum(amount).cast("double").alias(f"{name}_{k}"))
    return out


def charges_pivot(charges: DataFrame, p: ReportParams) -> DataFrame:
    """The rows of G27 summed per month order, one column for each
    analysis month and amount."""
    return charges.groupBy("active_month", "tenure", "account_id").agg(*_month_sums(p))


def charge_trend(pv: DataFrame, p: ReportParams) -> DataFrame:
    """Trend label and relative change for each pair of neighbouring
    analysis months."""
    out = []
    for name in ("mrc", "bill"):
        for k in range(1, len(p.analysis_months)):
            a, b = f"{name}_{k}", f"{name}_{k + 1}"
            out.append(X.trend_label(a, b).alias(f"{name}_trend_{k}_{k + 1}"))
            out.append(X.relative_change(a, b).alias(f"{name}_change_{k}_{k + 1}"))
    return pv.select("*", *out)


_BANDS = [label for _, label in X.TENURE_3] + [None]
_WORD = 62  # slots of one mask


def _slot(p: ReportParams):
    """The number of a row's (active month, tenure) slot, and how many there are."""
    month = F.array_position(F.array(*[F.lit(d) for d in p.active_months]), F.col("active_month")) - 1
    band = F.lit(len(_BANDS) - 1)
    for i, label in enumerate(_BANDS[:-1]):
        band = F.when(F.col("tenure") == label, i).otherwise(band)
    return (month * len(_BANDS) + band).cast("int"), len(p.active_months) * len(_BANDS)


def non_churner_charge_evolution(crm: DataFrame, p: ReportParams) -> DataFrame:
    """P04 body as one per-account aggregate.

    1. The month table: table-wide last snapshot per analysis month present,
       numbered in calendar order (one row per month, broadcast). It also
       carries the last of these months, so that the churn horizon needs no
       second read.
    2. Three column- and date-pruned slices of the CRM table are unioned:
       churn facts of every row (G24 needs the account's last churn and last
       snapshot over all time), month-end charge rows (G27), and active-month
       rows (G26).
    3. One groupBy on the account (partially aggregated, so a hot account
       never gathers its rows in one task) computes the churn test, the
       pivot of charges per month order (G28) and bit masks of the account's
       (active month, tenure) slots.
    4. Churned accounts (churn month within the horizon) and accounts with no
       month-end row are dropped; the masks are unfolded into one row per
       (active month, tenure), which is the literal fan-out of T16.

    No join between two large relations remains; the CRM table is shuffled
    once, as partial aggregates.
    """
    a_lo, a_hi = min(p.analysis_months), _month_end(max(p.analysis_months))
    rows = crm.where(F.col("snapshot_date").between(F.lit(a_lo), F.lit(a_hi)))
    stats = (
        rows.groupBy(X.month_start("snapshot_date").alias("month"))
        .agg(F.max("snapshot_date").alias("last_date"))
        .where(F.col("month").isin(*p.analysis_months))
    )
    # at most len(analysis_months) rows: the windows need no partition key
    month_end = bounded_broadcast(stats.select(
        "last_date", F.row_number().over(Window.orderBy("month")).alias("month_order"),
        F.max("month").over(Window.partitionBy()).alias("last_month"),
    ))

    slot, slots = _slot(p)
    null = {c: F.lit(None).cast(t) for c, t in (
        ("churn_ts", "timestamp_ntz"), ("snapshot_date", "date"), ("month_order", "int"), ("last_month", "date"),
        ("mrc_total", "decimal(18,2)"), ("billing_total", "decimal(18,2)"), ("slot", "int"))}

    def part(df: DataFrame, **have) -> DataFrame:
        return df.select("account_id", *[have.get(c, x).alias(c) for c, x in null.items()])

    facts = part(crm, churn_ts=F.col("churn_ts"), snapshot_date=F.col("snapshot_date"))
    ends = rows.join(month_end, rows["snapshot_date"] == month_end["last_date"])
    charges = part(ends, month_order=F.col("month_order"), last_month=F.col("last_month"),
                   mrc_total=X.net_recurring_charge(), billing_total=X.billed_total())
    act_lo, act_hi = min(p.active_months), _month_end(max(p.active_months))
    act = crm.where(F.col("snapshot_date").between(F.lit(act_lo), F.lit(act_hi))).select(
        "account_id", X.month_start("snapshot_date").alias("active_month"),
        X.tenure_band_3("age_months").alias("tenure"),
    ).where(F.col("active_month").isin(*p.active_months))
    active = part(act, slot=slot)

    masks = [F.bit_or(F.when(
        F.floor(F.col("slot") / _WORD) == w,
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % _WORD).cast("int")),
    )).alias(f"mask_{w}") for w in range(-(-slots // _WORD))]
    per = facts.unionByName(charges).unionByName(active).groupBy("account_id").agg(
        X.month_start(F.max("churn_ts")).alias("churn_month"),
        F.max("snapshot_date").alias("last_snapshot"),
        F.max("last_month").alias("last_month"),
        F.count("month_order").alias("month_end_rows"),
        *_month_sums(p),
        *masks,
    )
    churned = (F.month("churn_month") == F.month("last_snapshot")) & F.col("churn_month").between(
        F.col("last_month"), F.add_months("last_month", p.churn_horizon_months)
    )
    kept = per.where(~F.coalesce(churned, F.lit(False)) & (F.col("month_end_rows") > 0))
    held = F.array(*[F.coalesce(f"mask_{w}", F.lit(0).cast("long")) for w in range(len(masks))])
    hit = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.getbit(
        held[F.floor(i / _WORD).cast("int")], (i % _WORD).cast("int")) == 1)
    n = len(_BANDS)
    months = F.array(*[F.lit(d) for d in p.active_months])
    bands = F.array(*[F.lit(b).cast("string") for b in _BANDS])
    out = kept.select("account_id", *pivot_columns(p), F.explode(hit).alias("slot"))
    return charge_trend(out.select(
        months[F.floor(F.col("slot") / n).cast("int")].alias("active_month"),
        bands[(F.col("slot") % n).cast("int")].alias("tenure"), "account_id", *pivot_columns(p)), p)
