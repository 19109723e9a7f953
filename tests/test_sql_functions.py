"""The SQL-function versions of the helpers equal the Column versions."""

from pyspark.sql import functions as F

from subscope.functions import exprs as X
from subscope.functions.sql import register_sql_functions
from subscope.oracle.compare import same, spark_result
from subscope.sources.fixtures import fixture_tables

SF = "/root/testdata/sf0.01"


def test_sql_functions_equal_column_functions(spark):
    names = register_sql_functions(spark)
    assert "strip_acute_accents" in names
    t = fixture_tables(spark, SF)
    t.crm.createOrReplaceTempView("crm_snapshots")
    t.districts.createOrReplaceTempView("district_index")
    via_sql = spark.sql("""
        SELECT pad_contract_key(account_id) AS k, bundle_flag(bb_product_id, tv_product_id, vo_product_id) AS b,
               tenure_band_14(age_months) AS t14, tenure_band_4(age_months) AS t4, tenure_band_3(age_months) AS t3,
               calendar_month_diff(snapshot_date, to_date(install_ts)) AS md,
               month_name_es(month(snapshot_date)) AS mn,
               trend_label(bb_mrc, tv_mrc) AS tr, relative_change(bb_mrc, tv_mrc) AS rc
        FROM crm_snapshots""")
    via_cols = t.crm.select(
        X.pad_key("account_id").alias("k"), X.bundle_flag().alias("b"),
        X.tenure_band_14("age_months").alias("t14"), X.tenure_band_4("age_months").alias("t4"),
        X.tenure_band_3("age_months").alias("t3"),
        X.month_diff(F.col("snapshot_date"), F.to_date("install_ts")).alias("md"),
        X.month_name_es(F.month("snapshot_date")).alias("mn"),
        X.trend_label("bb_mrc", "tv_mrc").alias("tr"), X.relative_change("bb_mrc", "tv_mrc").alias("rc"),
    )
    ok, why = same(spark_result(via_sql), spark_result(via_cols))
    assert ok, why
    folded = spark.sql("SELECT strip_acute_accents(district) AS d FROM district_index")
    ok, why = same(spark_result(folded), spark_result(t.districts.select(X.strip_acute_accents("district").alias("d"))))
    assert ok, why
    plan = via_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_user_sql_over_registered_views(spark):
    """A user's own SQL over the canonical views and functions gives the
    same answer as the DataFrame report (here P16 and the P13 folding)."""
    from subscope.plans import reports as RP

    t = fixture_tables(spark, SF)
    t.views(spark)
    register_sql_functions(spark)
    sql = spark.sql("SELECT channel, count(DISTINCT contract_id) AS contracts FROM activations GROUP BY channel")
    ok, why = same(spark_result(sql), spark_result(RP.contracts_by_channel(t)))
    assert ok, why
    cov = spark.sql("""
        SELECT DISTINCT strip_acute_accents(i.district) AS district, c.district_code
        FROM district_index i LEFT JOIN (SELECT DISTINCT district_code FROM crm_snapshots) c
          ON upper(strip_acute_accents(i.district)) = c.district_code""")
    ok, why = same(spark_result(cov), spark_result(RP.district_catalog_coverage(t)))
    assert ok, why
