"""Sales cohort segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.operators.churn import in_year
from subscope.params import ReportParams

# Sale filters of the new-residential-sales cohort (fixed values).
NEW_SALE_TYPE = "Nueva"
RESIDENTIAL_TYPES = ("PROGRAMA HOGARES CONECTADOS", "RESIDENCIAL", "EMPLEADO")
SALE_MOVEMENT = "Altas por venta"
SALE_REASONS = ("VENTA NUEVA ", "VENTA")  # the trailing blank is part of the value


def crm_installs_in_year(crm: DataFrame, p: ReportParams) -> DataFrame:
    """Distinct (padded account, install timestamp) installed in the year."""
    return (
        crm.where(in_year("install_ts", p))
        .select(X.pad_key("account_id").alias("contract"), "install_ts")
        .distinct()
    )


def new_residential_sales(activations: DataFrame, p: ReportParams) -> DataFrame:
    """New residential sales of the year: distinct (padded contract,
    sale date, channel)."""
    a = activations.where(
        (F.col("sale_type") == NEW_SALE_TYPE)
        & F.col("customer_type").isin(*RESIDENTIAL_TYPES)
        & F.expr(in_year("sold_on", p))
        & (F.col("movement_type") == SALE_MOVEMENT)
        & F.col("reason").isin(*SALE_REASONS)
    )
    if p.excluded_subchannels:
        a = a.where(~F.col("subchannel").isin(*p.excluded_subchannels))
    return a.select(X.pad_key("contract_id").alias("contract"), "sold_on", "channel").distinct()


def confirmed_sales(crm: DataFrame, activations: DataFrame, p: ReportParams,
                    installs: DataFrame | None = None) -> DataFrame:
    """Sales whose CRM install day equals the sale day, with the sale
    month. No dedupe: two install timestamps on one day count twice.
    ``installs`` may be given as G19 computed from a shared aggregate."""
    installs = crm_installs_in_year(crm, p) if installs is None else installs
    inst = installs.select(
        F.col("contract").alias("i_contract"), F.to_date("install_ts").alias("install_day")
    )
    sales = new_residential_sales(activations, p)
    j = inst.join(sales, (inst["i_contract"] == sales["contract"]) & (inst["install_day"] == sales["sold_on"]))
    out = j.select("contract", "sold_on", F.month("sold_on").alias("sale_month"), "channel")
    if p.sale_month is not None:
        out = out.where(F.col("sale_month") == p.sale_month)
    return out


def churner_months(attribution: DataFrame) -> DataFrame:
    """Distinct attribution rows with the month name of the first churn.

    Attribution rows are distinct, and the one column dropped here (the
    order month) is a function of the contract (one first order date each),
    so the projection stays distinct without another aggregate."""
    return attribution.select(
        "contract", "last_churn", "first_churn", "voluntary_id", "involuntary_id",
        X.month_name_es(F.month("first_churn")).alias("churn_month_name"),
    )
