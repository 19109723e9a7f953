"""Broadband plan x speed pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.functions import exprs as X


def speed_by_contract(speeds: DataFrame) -> DataFrame:
    """Distinct (padded contract, speed range)."""
    return speeds.select(X.pad_key("contract_id").alias("contract"), "speed_range").distinct()


def plan_by_account(crm: DataFrame) -> DataFrame:
    """Distinct (padded account, plan name, plan id, plan price)."""
    return crm.select(
        X.pad_key("account_id").alias("contract"), "bb_product_name", "bb_product_id", "bb_mrc"
    ).distinct()


def plan_speed_price(crm: DataFrame, speeds: DataFrame) -> DataFrame:
    """Customers and mean price per (plan id, plan name, speed range).

    Dedupe before the join (T23): an account counts once per (plan, speed),
    and the mean is over its *distinct* prices, NULL prices skipped.
    """
    plans = plan_by_account(crm)
    sp = speed_by_contract(speeds)
    j = plans.join(sp, "contract")
    return j.groupBy("bb_product_id", "bb_product_name", "speed_range").agg(
        F.count_distinct("contract").alias("customers"), X.round2(F.avg("bb_mrc")).alias("mean_price")
    )
