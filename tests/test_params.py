"""Report parameters on the edge fixture."""

import dataclasses
import datetime as dt

import pytest

from pyspark.sql import functions as F

from subscope.params import DEFAULT_PARAMS as P
from subscope.plans import reports as RP
from subscope.plans import segments as SG


def test_strict_status_drops_cancelled_orders(edge):
    literal = {r.contract for r in SG.disconnect_first_orders(edge, P).collect()}
    strict = {r.contract for r in SG.disconnect_first_orders(edge, dataclasses.replace(P, strict_status=True)).collect()}
    assert "0000000006" in literal and "0000000006" not in strict


def test_churn_rate_by_month_and_inspect(edge):
    by_month = RP.district_churn_rate(edge, dataclasses.replace(P, by_month=True))
    assert "month" in by_month.columns
    total = RP.district_churn_rate(edge, P).agg(F.sum("churners")).first()[0]
    assert by_month.agg(F.sum("churners")).first()[0] == total
    counts = RP.district_churn_rate(edge, dataclasses.replace(P, inspect=True))
    assert counts.columns == ["district", "district_code", "contracts"]
    assert counts.where(F.col("district").isNull()).count() == 1  # unmatched codes kept as a group


def test_sales_options(edge):
    by_month = RP.new_sales_by_channel(edge, dataclasses.replace(P, by_sale_month=True))
    assert {(r.sale_month, r.channel, r.sales) for r in by_month.collect()} == {(2, "TIENDA", 1), (3, "WEB", 2)}
    march = RP.new_sales_by_channel(edge, dataclasses.replace(P, sale_month=3))
    assert {(r.channel, r.sales) for r in march.collect()} == {("WEB", 2)}
    no_shop = RP.new_sales_by_channel(edge, dataclasses.replace(P, excluded_subchannels=("TIENDA",)))
    assert no_shop.count() == 0
    by_sub = RP.contracts_by_channel(edge, dataclasses.replace(P, by_subchannel=True))
    assert by_sub.columns == ["subchannel", "contracts"]


def test_year_and_lead_window(edge):
    assert RP.bundle_churners_by_month(edge, dataclasses.replace(P, year=2020)).count() == 0
    wider = SG.churn_order_attribution(edge, dataclasses.replace(P, max_order_lead_months=4)).count()
    assert wider == SG.churn_order_attribution(edge, P).count() + 1  # E2 joins at a 4-month lead


def test_number_and_order_of_analysis_months(spark, edge):
    """Account 16 of the edge fixture, by hand: nets 0, 12.5, 12.5 (+5 of TV
    from June) at the month ends of May to July."""
    months = lambda *m: tuple(dt.date(2021, k, 1) for k in m)
    three = {(r.active_month, r.tenure): r for r in RP.mrc_non_churner_evolution(edge, P).where("account_id = '16'").collect()}
    assert {(k.month, t) for k, t in three} == {(7, "3M"), (8, "3M"), (8, "3M-6M")}
    r = three[dt.date(2021, 8, 1), "3M"]
    assert (r.mrc_1, r.mrc_2, r.mrc_3, r.mrc_trend_1_2, r.mrc_trend_2_3) == (0.0, 17.5, 17.5, "WENT UP", "SAME")
    two = dataclasses.replace(P, analysis_months=months(7, 6))
    df = RP.mrc_non_churner_evolution(edge, two)
    assert [c for c in df.columns if c.startswith("mrc")] == ["mrc_1", "mrc_2", "mrc_trend_1_2", "mrc_change_1_2"]
    assert {(r.mrc_1, r.mrc_2) for r in df.where("account_id = '16'").collect()} == {(17.5, 17.5)}
    four = dataclasses.replace(P, analysis_months=months(5, 6, 7, 8))
    row = RP.mrc_non_churner_evolution(edge, four).where("account_id = '16'").first()
    assert (row.mrc_1, row.mrc_2, row.mrc_3, row.mrc_4) == (0.0, 17.5, 17.5, 15.0)
    assert (row.mrc_trend_3_4, row.bill_2) == ("WENT DOWN", None)
    pivot = SG.charges_pivot(edge, four).where("account_id = '16'").first()
    assert (pivot.mrc_1, pivot.mrc_4) == (0.0, 15.0)


def test_repeated_and_odd_months(edge):
    once = dataclasses.replace(P, active_months=(dt.date(2021, 8, 1),))
    twice = dataclasses.replace(P, active_months=(dt.date(2021, 8, 1), dt.date(2021, 8, 1)))
    assert RP.mrc_non_churner_evolution(edge, once).count() == RP.mrc_non_churner_evolution(edge, twice).count() > 0
    many = dataclasses.replace(P, active_months=tuple(dt.date(2020 + k // 12, 1 + k % 12, 1) for k in range(36)))
    assert RP.mrc_non_churner_evolution(edge, many).where("account_id = '16'").count() == 5  # slots in three masks
    for bad in ((dt.date(2021, 8, 2),), ()):
        with pytest.raises(ValueError):
            dataclasses.replace(P, analysis_months=bad)


def test_active_ids_by_month(edge):
    all_months = RP.district_active_ids(edge, dataclasses.replace(P, active_month=None))
    split = RP.district_active_ids_by_month(edge, P)
    assert split.columns == ["month", *all_months.columns]
    august = RP.district_active_ids(edge, P)
    assert split.where("month = 8").drop("month").exceptAll(august).count() == 0
    assert split.agg(F.sum("actives")).first()[0] >= all_months.agg(F.sum("actives")).first()[0]


def test_catalogue_duplicate_check(spark, edge):
    from subscope.sources.tables import duplicate_catalogue_keys, warn_on_duplicate_catalogue

    assert warn_on_duplicate_catalogue(edge.districts) == 0
    doubled = edge.districts.unionByName(edge.districts.limit(1))
    assert duplicate_catalogue_keys(doubled).count() == 1
