"""Disconnect orders: earliest order per contract and its reason classes
(segments G01, G02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.params import ReportParams


def disconnect_orders(orders: DataFrame, p: ReportParams) -> DataFrame:
    """Disconnect orders with an open date, keyed by the padded contract (read
    where it is stored, see :mod:`subscope.sources.buckets`)."""
    contract = "contract" if "contract" in orders.columns else X.pad_key("contract_id").alias("contract")
    return orders.where(
        (F.col("order_type") == X.DISCONNECT)
        & X.status_kept("status", p.strict_status)
        & F.col("opened_on").isNotNull()
    ).select(contract, "opened_on", "sub_reason")


def dealt_contracts(rows: DataFrame, p: ReportParams) -> DataFrame:
    """Rows of a few per contract, dealt by it to ``p.contract_tasks`` tasks
    if that is given. A task then holds so few of them that a join takes them
    as a hash table and need not sort the rows it looks up there."""
    return rows if p.contract_tasks is None else rows.repartition(p.contract_tasks, "contract").hint("shuffle_hash")


def disconnect_first_orders(orders: DataFrame, p: ReportParams) -> DataFrame:
    """Earliest disconnect open date per padded contract."""
    return disconnect_orders(orders, p).groupBy("contract").agg(F.min("opened_on").alias("opened_on"))


def disconnect_reason_split(orders: DataFrame, p: ReportParams) -> DataFrame:
    """Orders on their contract's earliest date, ties kept, as distinct
    (contract, opened_on, involuntary_id, voluntary_id) rows.

    A non-payment reason makes the contract involuntary, any other non-null
    reason voluntary, a NULL reason neither; several first-day orders with
    different reasons give one row per reason class (T9).

    Instead of the literal aggregate + self-join (or a rank window, which puts
    a hot contract's orders in one task), each reason class gets its own
    conditional minimum in one partially-aggregated groupBy; a class is
    present on the first day iff its minimum equals the overall minimum. The
    result has at most three rows per contract.
    """
    o = disconnect_orders(orders, p)
    r = F.col("sub_reason")
    d = F.col("opened_on")
    per_contract = o.groupBy("contract").agg(
        F.min(F.when(r == X.NON_PAYMENT, d)).alias("d_inv"),
        F.min(F.when(r != X.NON_PAYMENT, d)).alias("d_vol"),
        F.min(F.when(r.isNull(), d)).alias("d_none"),
    )
    # one row per reason class present on the first day:
    # (involuntary id, voluntary id) = (contract, NULL) / (NULL, contract) / (NULL, NULL)
    first = "least(d_inv, d_vol, d_none)"
    none = "CAST(NULL AS STRING)"
    classes = (
        f"stack(3, d_inv = {first}, contract, {none}, d_vol = {first}, {none}, contract, "
        f"d_none = {first}, {none}, {none}) AS (hit, involuntary_id, voluntary_id)"
    )
    return dealt_contracts(per_contract.selectExpr("contract", f"{first} AS opened_on", classes).where("hit").drop("hit"), p)
