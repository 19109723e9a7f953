"""Results do not depend on the session or client time zone: the churn and
install times are wall-clock values (TIMESTAMP_NTZ)."""

import os
import time

import pytest

from subscope.oracle.compare import duck_result, same, spark_result
from subscope.oracle.sql import oracle_sql
from subscope.plans.registry import queries
from tests.conftest import SF_SMALL

KEYS = ["date_parts", "timestamp_to_date", "date_trunc_month", "crm_installs_in_year", "bundle_churners_by_month",
        "new_sales_by_channel"]


@pytest.fixture()
def far_from_utc(spark):
    old_env = os.environ.get("TZ")
    os.environ["TZ"] = "America/Costa_Rica"
    time.tzset()
    try:
        yield
    finally:
        if old_env is None:
            os.environ.pop("TZ", None)
        else:
            os.environ["TZ"] = old_env
        time.tzset()


@pytest.mark.parametrize("key", KEYS)
def test_same_answer_in_another_time_zone(spark, duck_small, far_from_utc, key):
    df = queries()[key](spark, SF_SMALL)  # the query sets the session zone itself ...
    spark.conf.set("spark.sql.session.timeZone", "America/Costa_Rica")  # ... a caller may change it afterwards
    try:
        ok, why = same(spark_result(df), duck_result(duck_small, oracle_sql()[key]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ok, why
