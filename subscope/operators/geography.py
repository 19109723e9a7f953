"""District catalogue matching and district-level counts.

The catalogue (one row per district of the country) gets no broadcast hint:
Spark broadcasts it while it is under its size thresholds (planning-time
statistics, then AQE at run time) and falls back to a sort-merge join beyond
them (see :mod:`subscope.operators.joins`). Reports count by location code
first and match the counts, so the match moves a row a place, not the CRM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.operators import distinct as D
from subscope.operators.churn import contract_days, explains
from subscope.operators.orders import disconnect_reason_split
from subscope.params import ReportParams

LOCATION = ["district_code", "canton_code", "province_code"]


def district_catalog_folded(districts: DataFrame) -> DataFrame:
    """Catalogue names with lower-case acute accents stripped (T10),
    plus the upper-cased match keys. Not de-duplicated (T22)."""
    return districts.select(
        X.strip_acute_accents("province").alias("province_name"),
        X.strip_acute_accents("canton").alias("canton_name"),
        X.strip_acute_accents("district").alias("district_name"),
        "economic_band",
        "ids_2017",
        X.folded_upper("district").alias("k_district"),
        X.folded_upper("canton").alias("k_canton"),
        X.folded_upper("province").alias("k_province"),
    )


def account_snapshot_dates(crm: DataFrame, with_tenure: bool = False) -> DataFrame:
    """One row per (account, snapshot date) with its month and, if asked,
    the 4-band tenure of the maximum age on that date."""
    if with_tenure:
        g = crm.groupBy("account_id", "snapshot_date").agg(X.tenure_band_4(F.max("age_months")).alias("tenure"))
    else:
        g = crm.select("account_id", "snapshot_date").distinct()
    return g.withColumn("month", F.month("snapshot_date"))


_TRIMMED = [f"{X.sql_trim_white(c)} AS {c}" for c in LOCATION]


def account_locations(crm: DataFrame, with_tenure: bool = False) -> DataFrame:
    """Distinct (account, month, trimmed location[, tenure]) of every
    snapshot.

    The literal self-join of CRM rows to their own (account, date) grain is
    replaced by one row per (account, month) with the set of its (date, age,
    location): bounded by the days of a month. The tenure, which is of the
    greatest age on a date over all of that date's rows, is read off that
    set, so the CRM is moved once, keyed by account and month.
    """
    if not with_tenure:
        return crm.selectExpr("account_id", "month(snapshot_date) AS month", *_TRIMMED).distinct()
    rows = crm.selectExpr("account_id", "month(snapshot_date) AS month", "snapshot_date", "age_months", *_TRIMMED)
    seen = rows.groupBy("account_id", "month").agg(
        F.expr(f"collect_set(struct(snapshot_date AS day, age_months AS age, {', '.join(LOCATION)})) AS seen"))
    oldest = "array_max(transform(filter(seen, x -> x.day = r.day), x -> x.age))"
    place = ", ".join(f"r.{c} AS {c}" for c in LOCATION)
    aged = seen.selectExpr("account_id", "month", f"transform(seen, r -> struct({place}, {oldest} AS age)) AS seen")
    banded = f"array_distinct(transform(seen, r -> struct({place}, {X.sql_band('r.age', X.TENURE_4)} AS tenure)))"
    return aged.selectExpr("account_id", "month", f"inline({banded})")


def active_counts(located: DataFrame) -> DataFrame:
    """(month, location[, tenure], actives): rows of :func:`account_locations`
    counted. They are distinct by account, so a plain count is the distinct
    count; it is partially aggregated before it moves, a row a place and
    task, however many accounts a place has."""
    return located.drop("account_id").groupBy(*[c for c in located.columns if c != "account_id"]).agg(
        F.expr("count(1) AS actives"))


def active_rollup(crm: DataFrame) -> DataFrame:
    """Distinct active accounts per month at every level of the (trimmed)
    location: district, canton, province and the whole country. The bitmaps
    of the districts are built once and merged upwards; an account that moved
    within a province counts once in it. Codes below the level are NULL."""
    located = account_locations(crm)
    maps = D.bitmaps(located, ["month", *LOCATION], "account_id", D.dense_ids(located, "account_id", near="district_code"))
    levels = [("district", ["province_code", "canton_code", "district_code"]), ("canton", ["province_code", "canton_code"]),
              ("province", ["province_code"]), ("country", [])]
    out = None
    for level, codes in levels:
        maps = D.merged(maps, ["month", *codes]) if level != "district" else maps
        have = [c if c in codes else f"CAST(NULL AS STRING) AS {c}" for c in ("province_code", "canton_code", "district_code")]
        part = D.counts(maps, ["month", *codes], "actives").selectExpr("month", f"'{level}' AS level", *have, "actives")
        out = part if out is None else out.union(part)
    return out


def with_catalogue(counts: DataFrame, districts: DataFrame, columns: list[str]) -> DataFrame:
    """G15 on counts by trimmed location: those of places in the catalogue,
    once for each different combination of the catalogue's ``columns``."""
    cat = district_catalog_folded(districts).select("k_district", "k_canton", "k_province", *columns).distinct()
    return _matched(counts, cat)


def _matched(located: DataFrame, cat: DataFrame, how: str = "inner") -> DataFrame:
    cond = (
        (located["district_code"] == cat["k_district"])
        & (located["canton_code"] == cat["k_canton"])
        & (located["province_code"] == cat["k_province"])
    )
    return located.join(cat, cond, how)


def district_match_full(located: DataFrame, districts: DataFrame, p: ReportParams,
                        how: str = "inner") -> DataFrame:
    """CRM locations matched to the catalogue on upper-cased folded
    district, canton and province. ``how='left'`` keeps unmatched CRM rows."""
    return _matched(located, district_catalog_folded(districts), how)


def district_names_folded(districts: DataFrame) -> DataFrame:
    """Distinct folded catalogue district names with their match key."""
    return districts.select(X.strip_acute_accents("district").alias("district")).distinct().withColumn(
        "k_district", F.upper("district")
    )


def district_match_name_only(crm: DataFrame, districts: DataFrame, p: ReportParams) -> DataFrame:
    """Last snapshot per (raw account, trimmed district code), matched to
    the catalogue on the district name alone, keeping unmatched CRM rows
    (NULL district); distinct (district, district_code, padded account,
    last_snapshot). Grouping is by the trimmed code (the alias, T6)."""
    per_acct = crm.groupBy("account_id", X.trim_white("district_code").alias("district_code")).agg(
        F.max("snapshot_date").alias("last_snapshot"))
    names = district_names_folded(districts)
    j = per_acct.join(names, per_acct["district_code"] == names["k_district"], "left")
    return j.select(
        "district", "district_code", X.pad_key("account_id").alias("account"), "last_snapshot"
    ).distinct()


def district_contract_counts(matched: DataFrame) -> DataFrame:
    """Rows of G16 per (district, code); NULL district is a group."""
    return matched.groupBy("district", "district_code").agg(F.count("account").alias("contracts"))


def contract_districts(crm: DataFrame, p: ReportParams) -> DataFrame:
    """One row per padded contract: ``seen``, the distinct (trimmed district
    code, last snapshot) of its raw accounts (G16 before the match), and the
    days of the churn core (``lasts``, ``firsts``).

    The CRM is aggregated by (account, district); an account's churn days are
    window extremes over its few districts, and a contract gathers distinct
    pairs and days, so neither a hot account nor a padded key of many
    spellings (T7) gathers rows."""
    fine = crm.selectExpr(
        "account_id", f"{X.sql_trim_white('district_code')} AS district_code", "snapshot_date", "to_date(churn_ts) AS cd"
    ).groupBy("account_id", "district_code").agg(
        F.expr("max(snapshot_date) AS district_last"), F.expr("max(cd) AS lc"), F.expr("min(cd) AS fc"))
    own = "OVER (PARTITION BY account_id)"
    rows = fine.select(X.pad_key("account_id").alias("contract"), F.expr("struct(district_code, district_last) AS pair"),
                       F.expr(f"max(lc) {own} AS last_churn"), F.expr(f"max(district_last) {own} AS last_snapshot"),
                       F.expr(f"min(fc) {own} AS first_churn"))
    return contract_days(rows, p, seen="collect_set(pair)")


def _contracts_with_order(crm: DataFrame, orders: DataFrame, p: ReportParams) -> DataFrame:
    """Contract rows with the earliest disconnect order and its number of
    reason classes, if there is one."""
    once = disconnect_reason_split(orders, p).groupBy("contract").agg(
        F.expr("min(opened_on) AS opened_on"), F.expr("count(1) AS classes"))
    return contract_districts(crm, p).join(once, "contract", "left")


def district_facts(crm: DataFrame, orders: DataFrame, p: ReportParams) -> DataFrame:
    """What :func:`district_counts` adds up, a row each: the rows of G16
    (``contracts`` 1, no first churn) and of G18 (``churners``, the ties of
    the order), with the first churn and its order's day. All are filtered by
    year and lead, then summed by code and month."""
    one = "struct(CAST(NULL AS DATE) AS first_churn, CAST(NULL AS DATE) AS opened_on, 1L AS contracts, 0L AS churners)"
    churn = "struct(f AS first_churn, opened_on, 0L AS contracts, classes AS churners)"
    hits = f"filter(firsts, f -> {explains('f', p)} AND f <= pair.district_last AND array_contains(lasts, pair.district_last))"
    j = _contracts_with_order(crm, orders, p).selectExpr("opened_on", "classes", "lasts", "firsts", "explode(seen) AS pair")
    return j.selectExpr(
        "pair.district_code", "month(pair.district_last) AS month",
        f"inline(concat(array({one}), transform({hits}, f -> {churn})))")


def district_counts(crm: DataFrame, orders: DataFrame, districts: DataFrame, p: ReportParams,
                    by_month: bool = False) -> DataFrame:
    """(district, district_code[, month], contracts, churners): the rows of
    G16, and of them those whose last snapshot is the last churn of an
    attributed churner (G17, G18), by the month of the last snapshot if
    asked; attribution ties count each (T9).

    Both counts come from one pass over the contract rows and are summed by
    code before the catalogue is matched by name, twelve months side by side,
    so a row a code and task is moved."""
    j = _contracts_with_order(crm, orders, p)
    j = j.selectExpr("classes", "lasts", f"filter(firsts, f -> {explains('f', p)}) AS firsts", "explode(seen) AS pair")
    j = j.selectExpr(
        "pair.district_code", "month(pair.district_last) AS month",
        "CASE WHEN array_contains(lasts, pair.district_last) THEN "
        "coalesce(classes * size(filter(firsts, f -> f <= pair.district_last)), 0L) ELSE 0L END AS n")
    months = range(1, 13) if by_month else ["month"]
    sums = j.groupBy("district_code").agg(*[F.expr(x) for m in months for x in (
        f"count(CASE WHEN month = {m} THEN 1 END) AS c_{m}", f"coalesce(sum(CASE WHEN month = {m} THEN n END), 0L) AS n_{m}")])
    names = district_names_folded(districts).groupBy("k_district").agg(F.expr("collect_set(district) AS names"))
    out = sums.join(names, sums["district_code"] == names["k_district"], "left")
    split = ", ".join(f"{m}, c_{m}, n_{m}" for m in months)
    out = out.selectExpr("district_code", f"stack({len(months)}, {split}) AS (month, contracts, churners)", "names"
                         ) if by_month else out.selectExpr(
        "district_code", "c_month AS contracts", "n_month AS churners", "names")
    keep = ["district_code", *(["month"] if by_month else []), "contracts", "churners"]
    return out.where("contracts > 0").selectExpr("explode_outer(names) AS district", *keep)
