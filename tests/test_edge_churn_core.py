"""Churn core on the hand-made edge fixture: hand-derived answers
(FIXTURES.md §3) and trap cases of SURVEY §2.13."""

from pyspark.sql import functions as F

from subscope.operators import churn as C
from subscope.params import DEFAULT_PARAMS as P
from subscope.plans import reports as RP
from subscope.plans import segments as SG
from subscope.sources.tables import Tables

E1_E10_ACCOUNTS = ["1", "2", "3", "4", "5", "6", "7", "8", "990000000009", "10"]
E1_E10_CONTRACTS = ["1", "2", "3", "4", "5", "6", "7", "8", "0000000009", "10"]


def _e1_e10(t: Tables) -> Tables:
    return Tables(
        crm=t.crm.where(F.col("account_id").isin(*E1_E10_ACCOUNTS)),
        orders=t.orders.where(F.col("contract_id").isin(*E1_E10_CONTRACTS)),
        activations=t.activations, speeds=t.speeds, districts=t.districts,
    )


def test_attribution_matches_hand_derived(edge):
    att = C.churn_core(_e1_e10(edge).crm, _e1_e10(edge).orders, P)
    got = sorted((r.contract, r.voluntary_id is not None, r.involuntary_id is not None) for r in att.collect())
    assert got == [
        ("0000000001", False, True),
        ("0000000003", True, False),
        ("0000000006", True, False),
        ("0000000007", False, True),
        ("0000000007", True, False),
        ("0000000009", False, False),
    ]


def test_p01_matches_hand_derived(edge):
    out = RP.bundle_churners_by_month(_e1_e10(edge))
    got = sorted(((r.month, r.bundle or "", r.churners, r.voluntary, r.involuntary) for r in out.collect()))
    assert got == sorted([
        (4, "1P - BB", 1, 0, 1),
        (5, "1P - BB", 3, 2, 1),
        (5, "1P - TV", 1, 1, 1),
        (5, "", 1, 1, 0),
    ])


def test_tie_counts_twice_in_churn_rate(edge):
    """Tied first-day orders give two attribution rows, and the
    non-distinct count of the district churn rate counts both (T9)."""
    rows = {r.district: r for r in RP.district_churn_rate(edge).collect()}
    r = rows["San Jose 3"]
    assert (r.contracts, r.churners) == (1, 2)
    assert r.churn_rate == 2.0


def test_raw_spellings_pair_across(edge):
    """Two raw spellings of one padded key pair up in G07."""
    real = SG.real_churners(edge).where(F.col("contract") == "0000000012")
    got = sorted((str(r.last_churn), str(r.first_churn)) for r in real.collect())
    assert got == [("2021-03-05", "2021-03-05"), ("2021-05-10", "2021-03-05"), ("2021-05-10", "2021-05-10")]


def test_two_installs_one_day_count_twice(edge):
    """G21 keeps both install timestamps of one day."""
    got = {r.channel: r.sales for r in RP.new_sales_by_channel(edge).collect()}
    assert got["WEB"] == 2


def test_trailing_blank_reason_is_part_of_the_value(edge):
    s = SG.new_residential_sales(edge).collect()
    assert "0000000007" not in {r.contract for r in s}


def test_trimmed_district_groups_both_spellings(edge):
    """Codes with and without blanks form one trimmed group."""
    m = SG.district_match_name_only(edge).where(F.col("account") == "0000000013").collect()
    assert [(r.district, r.district_code) for r in m] == [("San Jose 2", "SAN JOSE 2")]


def test_catalogue_coverage_uses_untrimmed_codes(edge):
    """P13 compares the raw CRM code: the blank-padded spelling never matches."""
    rows = {(r.district, r.district_code) for r in RP.district_catalog_coverage(edge).collect()}
    assert ("San Jose 2", "SAN JOSE 2") in rows
    assert ("Ávila", None) in rows  # upper-case accent survives (T10)


def test_two_tenure_bands_in_one_month(edge):
    """An account with two 3-band tenures in August appears in both."""
    out = RP.mrc_non_churner_evolution(edge).where(F.col("account_id") == "16").collect()
    aug = sorted(r.tenure for r in out if str(r.active_month) == "2021-08-01")
    assert aug == ["3M", "3M-6M"]
    r = out[0]
    assert r.bill_2 is None  # NULL broadband bill makes the total NULL
    assert r.mrc_change_1_2 is None  # zero base


def test_tenure_rows_in_calendar_order(spark):
    """Labels are kept, rows are ordered by the band's rank, not by text."""
    from subscope.functions import exprs as X
    from subscope.sources.fixtures import fixture_tables

    rows = RP.bundle_active_tenure(fixture_tables(spark, "/root/testdata/sf0.001")).collect()
    order = {label: i for i, (_, label) in enumerate(X.TENURE_14)}
    for a, b in zip(rows, rows[1:]):
        if a.month == b.month:
            assert order.get(a.tenure, -1) <= order.get(b.tenure, -1)


def test_district_churners_hand_derived(edge):
    """P06 (month 8): E15 and E19 churn in August; their locations (E19's
    after trimming a tab) match the catalogue row for San José 1 / Cantón 1 /
    Región 1."""
    got = [tuple(r) for r in RP.district_churners(edge).collect()]
    assert got == [("SAN JOSE 1", "CANTON 1", "REGION 1", 2)]


def test_sales_churners_hand_derived(edge):
    """E3 was sold on its install day (2021-02-01), before its first
    churn (2021-05-10), and is attributed as voluntary."""
    got = [tuple(r) for r in RP.new_sales_churners_by_channel(edge).collect()]
    assert got == [("Mayo", 2, "TIENDA", 1, 1, 0)]


def test_contracts_by_channel_hand_derived(edge):
    got = {(r.channel, r.contracts) for r in RP.contracts_by_channel(edge).collect()}
    assert got == {("TIENDA", 3), ("WEB", 2)}


def test_plan_speed_price_hand_derived(edge):
    """P05 (T23): an account counts once per (plan, speed) and the mean is
    over its distinct prices: account 16 has 0, 12.5 and 10, account 1 has 10,
    so (10 + 0 + 12.5 + 10) / 4 = 8.125, rounded half-up to 8.13."""
    got = {(r.bb_product_id, r.bb_product_name, r.speed_range, r.customers, r.mean_price)
           for r in RP.plan_speed_price(edge).collect()}
    assert got == {
        ("BB1", "Internet 1", "50 Mbps", 2, 8.13),
        ("BB1", "Internet 1", "100 Mbps", 2, 10.0),
        (None, None, "100 Mbps", 1, 10.0),
    }


def test_district_active_ids_hand_derived(edge):
    """P09 (month 8): tenure is per (account, snapshot date), so an account
    with two dates in August can fall in two bands (E15: 6M and 2Y+). E18
    and E19 match once the white space of their codes is trimmed."""
    got = {(r.district_name, r.economic_band, r.ids_2017, r.tenure, r.actives)
           for r in RP.district_active_ids(edge).collect()}
    assert got == {
        ("San Jose 1", "E1", 1.5, "6M", 2),
        ("San Jose 1", "E1", 1.5, "2Y+", 1),
        ("San Jose 1", "E1", 1.5, "06-1Y", 3),
    }


def test_p03_matches_hand_derived(edge):
    """P03 on E1-E10: every age is 10, band '9M-10M' (upper bound inclusive),
    so the rows are P01's with that tenure."""
    out = RP.bundle_churner_tenure(_e1_e10(edge))
    got = sorted((r.month, r.bundle or "", r.tenure, r.churners, r.voluntary, r.involuntary) for r in out.collect())
    assert got == sorted([
        (4, "1P - BB", "9M-10M", 1, 0, 1),
        (5, "1P - BB", "9M-10M", 3, 2, 1),
        (5, "1P - TV", "9M-10M", 1, 1, 1),
        (5, "", "9M-10M", 1, 1, 0),
    ])
