"""Counters of the input traps, taken while a report runs.

The reports keep some odd inputs as they are: long ids lose their front (T1),
an order without a status drops out (T2), months of several years merge (T5),
other spellings of a key may meet on one contract (T7), a bill that is no
number counts as none (T8). :func:`watched` gives the tables with counters of
such rows; they are filled by the scans that a report makes anyway.

Off by default: no filter is moved below a counter, so a report that prunes
snapshot dates reads all of them, and the watched columns are read too. The
counts are warnings, not results: a stage that is run again after a lost
executor may count its rows again.
"""

from __future__ import annotations

import dataclasses
import logging
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.sources.tables import Tables


def _rows_where(condition: str, name: str):
    return F.expr(f"count_if({condition}) AS {name}")


def _spelling(column: str) -> list:
    return [_rows_where(f"length({column}) > {X.KEY_WIDTH}", "long_ids"),
            _rows_where(f"length({column}) < {X.KEY_WIDTH}", "short_ids")]


class Watch:
    """The counters of one run of one report."""

    def __init__(self) -> None:
        run = uuid.uuid4().hex  # counters of two reports never share a name
        self.seen = {name: Observation(f"{name}_{run}") for name in ("crm_snapshots", "service_orders")}

    def tables(self, t: Tables) -> Tables:
        unread = X.number_from_text("vo_billed_raw").isNull() & F.col("vo_billed_raw").isNotNull()
        crm = t.crm.observe(
            self.seen["crm_snapshots"], F.expr("count(1) AS row_count"), *_spelling("account_id"),
            F.min(F.year("snapshot_date")).alias("first_year"), F.max(F.year("snapshot_date")).alias("last_year"),
            F.count_if(unread).alias("unread_bills"))
        orders = t.orders.observe(
            self.seen["service_orders"], F.expr("count(1) AS row_count"), *_spelling("contract_id"),
            _rows_where(f"order_type = {X.quoted(X.DISCONNECT)} AND status IS NULL", "disconnects_without_status"),
            _rows_where(f"order_type = {X.quoted(X.DISCONNECT)} AND opened_on IS NULL", "disconnects_without_day"))
        return dataclasses.replace(t, crm=crm, orders=orders)

    def counts(self, report: DataFrame) -> dict[str, dict[str, int]]:
        """The counts by table, of the tables that ``report`` reads, once an
        action on it has ended."""
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        return {name: o.get for name, o in self.seen.items() if o._name in plan}


def watched(t: Tables) -> tuple[Tables, Watch]:
    """The tables with counters, for one report, and the counters."""
    w = Watch()
    return w.tables(t), w


def warnings(counts: dict[str, dict[str, int]]) -> list[str]:
    """What the counts of a run say, a line a trap that occurred."""
    crm, orders = counts.get("crm_snapshots", {}), counts.get("service_orders", {})
    out = []
    for table, c in counts.items():
        if c.get("long_ids"):
            out.append(f"T1: {c['long_ids']} rows of {table} have ids over {X.KEY_WIDTH} characters, whose front is cut")
        if c.get("short_ids"):
            out.append(f"T7: {c['short_ids']} rows of {table} have unpadded ids, which may meet a padded spelling")
    if orders.get("disconnects_without_status"):
        out.append(f"T2: {orders['disconnects_without_status']} disconnect orders have no status and do not count")
    if crm.get("first_year") != crm.get("last_year"):
        out.append(f"T5: snapshots are of the years {crm['first_year']} to {crm['last_year']}, whose months merge")
    if crm.get("unread_bills"):
        out.append(f"T8: {crm['unread_bills']} bills are no numbers and count as none")
    return out


def log_warnings(report: str, counts: dict[str, dict[str, int]], log: logging.Logger | None = None) -> None:
    for line in warnings(counts):
        (log or logging.getLogger("subscope")).warning("%s: %s", report, line)
