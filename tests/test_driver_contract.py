"""The driver's entry points."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["month", "bundle", "churners", "voluntary", "involuntary"]


def test_keys_cover_survey_inventory():
    q, s = E.queries(), E.oracle_sql()
    own = {k for k in q if k != "pipeline" and not k.startswith("op")}
    assert own <= set(s) and set(s) <= set(q)
    reports = {
        "bundle_churners_by_month", "bundle_active_tenure", "bundle_churner_tenure", "mrc_non_churner_evolution",
        "plan_speed_price", "district_churners", "district_churners_tenure", "district_churners_ids",
        "district_active_ids", "district_active_economic_by_month", "district_churn_rate",
        "district_churn_rate_by_month", "district_catalog_coverage", "new_sales_by_channel",
        "new_sales_churners_by_channel", "contracts_by_channel",
    }
    assert reports <= set(q)
    assert len(q) >= 80
