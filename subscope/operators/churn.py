"""CRM churn segments and the churn-to-order attribution.

Every segment is keyed by the padded contract. The CRM table enters through
one partially aggregated groupBy per report, at the grain the report needs
(account; account x churn date; account x install time; account x
location); the reports read it through one row per contract, the segments
through role rows (:mod:`subscope.operators.roles`).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.operators.order_filter import counted, maybe_among
from subscope.operators.orders import dealt_contracts, disconnect_orders, disconnect_reason_split
from subscope.operators.roles import stack_roles
from subscope.params import ReportParams

# Bundle slots of the per-account summary: one per owned-products code
# (7 labels plus "no product"), as (column name, label, code).
_BUNDLE_SLOTS = [(f"fc_{code}", label, code) for code, label in X.BUNDLE_BY_CODE.items()]


def _agg(df: DataFrame, keys: list[str], **aggs: str) -> DataFrame:
    """``groupBy`` with aggregates as SQL text (one call to Spark each)."""
    return df.groupBy(*keys).agg(*[F.expr(f"{sql} AS {name}") for name, sql in aggs.items()])


def keyed(crm: DataFrame) -> DataFrame:
    """CRM rows with their padded contract (read where it is stored, see
    :mod:`subscope.sources.buckets`)."""
    return crm if "contract" in crm.columns else crm.withColumn("contract", X.pad_key("account_id"))


def with_disconnect_order(crm: DataFrame, orders: DataFrame, p: ReportParams) -> DataFrame:
    """Keyed CRM rows of the contracts that have a disconnect order. Only
    these can be attributed, so the churn reports drop the others before
    anything is aggregated. As a sort-merge join it moves the CRM once, keyed
    by contract, and the steps that follow stay on that partitioning.

    With ``p.order_filter_keys`` (the number of these contracts, see
    :func:`with_order_filter`) a Bloom filter drops nearly all other rows
    before that move.

    With ``p.contract_tasks`` both sides are dealt to that many tasks (or the
    session's shuffle partitions, if these are more), which the steps by
    contract that follow keep, so a task's rows are bounded whatever the
    table's size: adaptive execution merges the partitions that it makes
    itself, and there are only so many of them."""
    contracts = disconnect_orders(orders, p).select("contract").distinct()
    rows = keyed(crm)
    if p.order_filter_keys is None and p.contract_tasks is None:
        return rows.join(contracts, "contract", "left_semi")
    if p.order_filter_keys is not None:
        rows = maybe_among(rows, "contract", contracts, p.order_filter_keys)
    if p.contract_tasks is not None:
        rows = rows.repartition(p.contract_tasks, "contract")
    # an inner join with distinct contracts: a semi-join would be moved below the filter's join or the move
    return rows.join(dealt_contracts(contracts, p), "contract")


def with_order_filter(orders: DataFrame, p: ReportParams) -> ReportParams:
    """``p`` with the Bloom filter on, sized by counting the contracts."""
    return dataclasses.replace(p, order_filter_keys=counted(disconnect_orders(orders, p), "contract"))


def _dated(crm: DataFrame, *more: str) -> DataFrame:
    return keyed(crm).selectExpr("contract", "account_id", "snapshot_date", "to_date(churn_ts) AS cd", *more)


def in_year(day: str, p: ReportParams) -> str:
    """SQL test that a day is in the report year (any, if there is none)."""
    return f"{day} IS NOT NULL" if p.year is None else f"year({day}) = {int(p.year)}"


def account_churn_summary(crm: DataFrame) -> DataFrame:
    """One row per raw account: padded key, last / first churn date, last
    snapshot, and the first churn date under each bundle label.

    One scan and one partially aggregated groupBy replace the four separate
    CRM aggregates of the literal reports (last churn, first churn, bundle at
    first churn). Per-bundle minima are conditional aggregates over the fixed
    set of labels, so a hot account never gathers its rows in one task.
    """
    slots = {name: f"min(CASE WHEN bcode = {code} THEN cd END)" for name, _, code in _BUNDLE_SLOTS}
    return _agg(_dated(crm, f"{X.BUNDLE_CODE} AS bcode"), ["contract", "account_id"], last_churn="max(cd)",
                last_snapshot="max(snapshot_date)", first_churn="min(cd)", **slots)


def churn_roles(summary: DataFrame, p: ReportParams, bundles: bool = True) -> DataFrame:
    """All per-account facts the churn core needs, as one row set keyed by
    the padded contract: ``role`` 'L' = last churn passing the month test
    (G03), 'F' = first churn in the report year (G06), 'B' = first churn in
    the year under a bundle label (G09).

    Every consumer filters this one relation by role, so the aggregate below
    it is computed (and shuffled) once for the whole core (see
    :mod:`subscope.operators.roles`). The rows are deduplicated per padded
    key (a partial aggregate): however many raw spellings share a key, each
    branch sees at most one row per (key, date), so the last x first
    pairing of G07 is bounded by distinct dates, not by spellings.
    """
    no_label = "CAST(NULL AS STRING)"
    roles = [
        ("L", ["contract", no_label, "CASE WHEN month(last_churn) = month(last_snapshot) THEN last_churn END"]),
        ("F", ["contract", no_label, f"CASE WHEN {in_year('first_churn', p)} THEN first_churn END"]),
    ]
    for name, label, _ in _BUNDLE_SLOTS if bundles else []:
        roles.append(("B", ["contract", X.quoted(label), f"CASE WHEN {in_year(name, p)} THEN {name} END"]))
    return stack_roles(summary, roles, ["contract", "bundle", "day"]).where(F.col("day").isNotNull()).distinct()


def contract_days(summary: DataFrame, p: ReportParams, **more: str) -> DataFrame:
    """One row per contract with the days the churn core works on: ``lasts``,
    the last churns that pass the month test (G03), ``firsts``, the first
    churns in the report year (G06), ``bundles``, the (label, day) of first
    churns in the year under each bundle (G09) if the summary carries them.

    Everything a report needs of a contract is in this row, so the CRM
    aggregate has one consumer. The sets hold distinct days, so they are
    bounded by the calendar however many raw spellings share a key (T7).
    ``more`` adds aggregates (SQL) of the summary's rows.
    """
    have = summary.columns
    aggs = {"lasts": "collect_set(CASE WHEN month(last_churn) = month(last_snapshot) THEN last_churn END)",
            "firsts": f"collect_set(CASE WHEN {in_year('first_churn', p)} THEN first_churn END)"}
    slots = ", ".join(f"named_struct('bundle', {X.quoted(label)}, 'day', {name})"
                      for name, label, _ in _BUNDLE_SLOTS if name in have)
    if slots:
        aggs["bundles"] = f"array_distinct(flatten(collect_set(filter(array({slots}), b -> {in_year('b.day', p)}))))"
    return _agg(summary, ["contract"], **aggs, **more)


def explains(first: str, p: ReportParams) -> str:
    """Whether the contract's earliest disconnect order explains a first
    churn: opened on or before it, at most some calendar months earlier (T3)."""
    bound = p.max_order_lead_months
    near = "" if bound is None else f" AND {X.sql_month_diff(first, 'opened_on')} <= {int(bound)}"
    return f"{first} >= opened_on{near}"


def attributed(days: DataFrame, split: DataFrame, p: ReportParams, keep: tuple[str, ...] = ()) -> DataFrame:
    """G07 and G08 from the contract rows: pairs of a first and a last churn,
    first on or before last, with the contract's earliest disconnect order if
    it was opened on or before the first churn and at most
    ``max_order_lead_months`` calendar months earlier (T3)."""
    j = days.join(split, "contract").where("size(lasts) > 0")
    j = j.selectExpr("*", f"explode(filter(firsts, f -> {explains('f', p)})) AS first_churn")
    j = j.selectExpr("*", "explode(filter(lasts, l -> l >= first_churn)) AS last_churn")
    return j.selectExpr(
        "contract", "voluntary_id", "involuntary_id", "last_churn", "first_churn", "month(last_churn) AS last_churn_month",
        "month(first_churn) AS first_churn_month", "month(opened_on) AS order_month", *keep)


def churn_date_summary(crm: DataFrame) -> DataFrame:
    """Per account the churn summary of :func:`account_churn_summary` and
    ``ages``: for each churn date the maximum age and the first install date
    of its rows. One CRM aggregate at (account, churn date), rolled up."""
    held = {name: f"max(CASE WHEN bcode = {code} THEN true END)" for name, _, code in _BUNDLE_SLOTS}
    fine = _agg(_dated(crm, f"{X.BUNDLE_CODE} AS bcode", "age_months", "to_date(install_ts) AS installed"),
                ["contract", "account_id", "cd"], ms="max(snapshot_date)", ma="max(age_months)", mi="min(installed)", **held)
    first = {name: f"min(CASE WHEN {name} THEN cd END)" for name, _, _ in _BUNDLE_SLOTS}
    return _agg(fine, ["contract", "account_id"], last_churn="max(cd)", last_snapshot="max(ms)", first_churn="min(cd)",
                **first, ages="collect_set(CASE WHEN cd IS NOT NULL THEN struct(cd, ma, mi) END)")


def on_last_churn(field: str) -> str:
    """``ma`` or ``mi`` of the rows dated on ``last_churn``, over every raw
    spelling of the key (G11), from the contract's ``ages`` (SQL)."""
    best = "array_max" if field == "ma" else "array_min"
    return f"{best}(transform(filter(ages, a -> a.cd = last_churn), a -> a.{field}))"


def install_summary(crm: DataFrame) -> DataFrame:
    """Per account the last / first churn and snapshot dates and its distinct
    install days."""
    return _agg(_dated(crm, "to_date(install_ts) AS installed"), ["contract", "account_id"], last_churn="max(cd)",
                last_snapshot="max(snapshot_date)", first_churn="min(cd)", installs="collect_set(installed)")


def crm_last_churn(roles: DataFrame) -> DataFrame:
    """Last churn date per raw account, kept when its month equals the
    month of the account's last snapshot (month numbers only, T4)."""
    return roles.where(F.col("role") == "L").select(
        "contract", F.col("day").alias("last_churn"), F.month("day").alias("last_churn_month")
    )


def crm_first_churn(roles: DataFrame) -> DataFrame:
    """First churn date per raw account, kept when in the report year."""
    return roles.where(F.col("role") == "F").select(
        "contract", F.col("day").alias("first_churn"), F.month("day").alias("first_churn_month")
    )


def real_churners(last: DataFrame, first: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Last-churn rows joined to first-churn rows on the padded key with
    first <= last. ``extra`` carries location / tenure columns of the
    last-churn side.

    The join stays (rather than one fused aggregate) because two raw
    spellings of one padded key pair up across each other (T7, T17). Both
    inputs are distinct per padded key and date (and location), so the
    output is distinct without a further aggregate.
    """
    extra = extra or []
    f = first.select(F.col("contract").alias("f_contract"), "first_churn", "first_churn_month")
    j = last.join(f, (last["contract"] == f["f_contract"]) & (f["first_churn"] <= last["last_churn"]))
    return j.select("contract", "last_churn", "first_churn", "last_churn_month", "first_churn_month", *extra)


def churn_order_attribution(real: DataFrame, split: DataFrame, p: ReportParams,
                            extra: list[str] | None = None) -> DataFrame:
    """G08 interval join: churners with their earliest disconnect order opened
    on or before the first churn and at most ``max_order_lead_months``
    calendar months earlier (T3).

    Both inputs are distinct and ``split`` has one open date per contract, so
    the join output is already distinct on the reported columns; the equi
    key drives a hash / sort-merge join and the date range is a residual
    condition (no nested loop).
    """
    extra = extra or []
    s = split.select(F.col("contract").alias("s_contract"), "opened_on", "involuntary_id", "voluntary_id")
    cond = (
        (real["contract"] == s["s_contract"])
        & (real["first_churn"] >= s["opened_on"])
        & (X.month_diff(real["first_churn"], s["opened_on"]) <= p.max_order_lead_months)
    )
    return real.join(s, cond).select(
        "contract", "voluntary_id", "involuntary_id", "last_churn", "first_churn",
        "last_churn_month", "first_churn_month", F.month("opened_on").alias("order_month"), *extra,
    )


def bundle_at_first_churn(roles: DataFrame) -> DataFrame:
    """Per (account, bundle label) the first churn date under that
    label, kept when in the report year; keyed by padded contract."""
    return roles.where(F.col("role") == "B").select("contract", "bundle", F.col("day").alias("bundle_first_churn"))


def churn_core(crm: DataFrame, orders: DataFrame, p: ReportParams, summary: DataFrame | None = None) -> DataFrame:
    """The attribution rows (G08) of the account-level churn reports. A
    caller that already aggregates the CRM table passes its own per-account
    ``summary`` to avoid a second scan."""
    if summary is None:
        summary = account_churn_summary(with_disconnect_order(crm, orders, p))
    return attributed(contract_days(summary, p), disconnect_reason_split(orders, p), p)


# --- location-aware variants (district reports) -----------------------------

LOCATION = ["district_code", "canton_code", "province_code"]


def _located(crm: DataFrame) -> DataFrame:
    return _dated(crm, "age_months", *[f"{X.sql_trim_white(c)} AS {c}" for c in LOCATION])


def crm_last_churn_by_location(crm: DataFrame, with_tenure: bool = False) -> DataFrame:
    """Last churn per padded contract and trimmed location, kept
    when its month equals the month of the group's last snapshot; G05 adds
    the 4-band tenure of the group's maximum age."""
    g = _agg(_located(crm), ["contract", *LOCATION], last_churn="max(cd)", last_snapshot="max(snapshot_date)",
             max_age="max(age_months)").where("month(last_churn) = month(last_snapshot)")
    tenure = [f"{X.sql_band('max_age', X.TENURE_4)} AS tenure"] if with_tenure else []
    return g.selectExpr("contract", "last_churn", "month(last_churn) AS last_churn_month", *LOCATION, *tenure)


def contract_places(crm: DataFrame, p: ReportParams) -> DataFrame:
    """One row per contract: ``places``, per trimmed location the last churn
    that passes the month test and the maximum age (G04, G05), and
    ``firsts``, the first churns in the year of its raw accounts (G06).

    The one CRM aggregate is by (contract, account, location). The steps
    above it stay on the partitioning by contract that the semi-join leaves,
    and the row is bounded by distinct places and days: raw spellings of a
    key are merged before they are gathered (T7)."""
    fine = _agg(_located(crm), ["contract", "account_id", *LOCATION], last_churn="max(cd)",
                last_snapshot="max(snapshot_date)", first_churn="min(cd)", max_age="max(age_months)")
    fine = fine.selectExpr("*", "min(first_churn) OVER (PARTITION BY contract, account_id) AS account_first")
    per = _agg(fine, ["contract", *LOCATION], last_churn="max(last_churn)", last_snapshot="max(last_snapshot)",
               max_age="max(max_age)",
               firsts=f"collect_set(CASE WHEN {in_year('account_first', p)} THEN account_first END)")
    place = f"struct({', '.join(LOCATION)}, last_churn, max_age)"
    return _agg(per, ["contract"], firsts="array_distinct(flatten(collect_list(firsts)))",
                places=f"collect_list(CASE WHEN month(last_churn) = month(last_snapshot) THEN {place} END)")


def churners_by_place(crm: DataFrame, orders: DataFrame, p: ReportParams, month: int | None,
                      with_tenure: bool = False) -> DataFrame:
    """(location, [tenure], churners): attribution rows (G08) by the
    churner's trimmed location, for one month of the last churn or all.
    They are counted before the catalogue is matched: a row a place and task
    is moved, however many churners a place has."""
    j = churner_places(crm, orders, p)
    if month is not None:
        j = j.where(f"month(last_churn) = {int(month)}")
    keys = list(LOCATION)
    if with_tenure:
        j = j.withColumn("tenure", F.expr(X.sql_band("max_age", X.TENURE_4)))
        keys.append("tenure")
    return j.groupBy(*keys).agg(F.expr("count(1) AS churners"))


def churner_places(crm: DataFrame, orders: DataFrame, p: ReportParams) -> DataFrame:
    """Attribution rows (G08) by the churner's trimmed location, with the two
    churn days, the order's day and the greatest age."""
    days = contract_places(with_disconnect_order(crm, orders, p), p)
    j = days.join(disconnect_reason_split(orders, p).select("contract", "opened_on"), "contract")
    j = j.selectExpr("opened_on", "places", f"explode(filter(firsts, f -> {explains('f', p)})) AS first_churn")
    return j.selectExpr("opened_on", "first_churn", "inline(places)").where("first_churn <= last_churn")
