"""Column-expression vectors (FIXTURES.md §4), evaluated by Spark."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subscope.functions import exprs as X


def _eval(spark, expr_fn, values, dtype):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", dtype)]))
    return [r[0] for r in df.select(expr_fn(F.col("x"))).collect()]


def _eval2(spark, expr_fn, pairs, dtype):
    schema = T.StructType([T.StructField("a", dtype), T.StructField("b", dtype)])
    df = spark.createDataFrame(pairs, schema)
    return [r[0] for r in df.select(expr_fn(F.col("a"), F.col("b"))).collect()]


def test_pad_key(spark):
    got = _eval(spark, X.pad_key, ["7", "1234567890", "123456789012", None], T.StringType())
    assert got == ["0000000007", "1234567890", "3456789012", None]


def test_month_diff(spark):
    D = dt.date
    pairs = [(D(2021, 2, 1), D(2021, 1, 31)), (D(2021, 4, 30), D(2021, 1, 1)), (D(2021, 5, 10), D(2021, 1, 31))]
    assert _eval2(spark, X.month_diff, pairs, T.DateType()) == [1, 3, 4]


@pytest.mark.parametrize("fn,cases", [
    (X.tenure_band_14, [(1, "1M"), (1.5, "1M-2M"), (2, "1M-2M"), (12, "11M-1Y"), (12.5, "1Y-2Y"), (24, "1Y-2Y"),
                        (24.5, "2Y+"), (None, None), (0, "1M"), (11, "10M-11M")]),
    (X.tenure_band_4, [(6, "6M"), (7, "06-1Y"), (12, "06-1Y"), (24, "1Y-2Y"), (25, "2Y+"), (None, None)]),
    (X.tenure_band_3, [(3, "3M"), (6, "3M-6M"), (7, "6M+"), (None, None)]),
])
def test_tenure_bands(spark, fn, cases):
    got = _eval(spark, fn, [None if v is None else float(v) for v, _ in cases], T.DoubleType())
    assert got == [label for _, label in cases]


def test_trend_and_change(spark):
    pairs = [(2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (None, 1.0)]
    assert _eval2(spark, X.trend_label, pairs, T.DoubleType()) == ["WENT DOWN", "SAME", "WENT UP", None]
    pairs = [(4.0, 5.0), (0.0, 5.0), (None, 5.0)]
    assert _eval2(spark, X.relative_change, pairs, T.DoubleType()) == [0.25, None, None]


def test_accent_strip(spark):
    got = _eval(spark, X.strip_acute_accents, ["San José", "Ávila", "Güímar"], T.StringType())
    assert got == ["San Jose", "Ávila", "Güimar"]


def test_number_from_text(spark):
    texts = ["7", "N/A", None, "12d", "5f", "1e3", " 7 ", "", "-.5", "+3.", ".", "Infinity", "NaN", "\u00a04\t", "0x1", "1 2"]
    want = [7.0, None, None, None, None, 1000.0, 7.0, None, -0.5, 3.0, None, None, None, 4.0, None, None]
    assert _eval(spark, X.number_from_text, texts, T.StringType()) == want


def test_trim_white(spark):
    got = _eval(spark, X.trim_white, [" a b ", "\ta\u00a0", "\u2003a\n", " ", None], T.StringType())
    assert got == ["a b", "a", "a", "", None]


def test_quoted_labels(spark):
    for text in ("it's", "a\\b", "''", None):
        assert spark.sql(f"SELECT {X.quoted(text)} AS x").first().x == text


def test_round2_half_up(spark):
    got = _eval(spark, X.round2, [1.005, 2.675, 0.125, 24.465], T.DoubleType())
    assert got == [1.01, 2.68, 0.13, 24.47]


def test_bundle_flag_all_combinations(spark):
    rows = [(b, t, v) for b in ("B", None) for t in ("T", None) for v in ("V", None)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("bb_product_id", "tv_product_id", "vo_product_id")])
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(X.bundle_flag()).collect()]
    assert got == ["3P", "2P - BB+TV", "2P - BB+VO", "1P - BB", "2P - TV+VO", "1P - TV", "1P - VO", None]


def test_month_names_round_trip(spark):
    got = _eval(spark, lambda c: X.month_number_es(X.month_name_es(c)), list(range(1, 13)), T.IntegerType())
    assert got == list(range(1, 13))


def test_status_predicate(spark):
    vals = ["CANCELADA", "ANULADA", "FINALIZADA", None]
    assert _eval(spark, X.status_kept, vals, T.StringType()) == [True, True, True, False]
    assert _eval(spark, lambda c: X.status_kept(c, strict=True), vals, T.StringType()) == [False, False, True, None]


def test_bundle_code_matches_label(spark):
    rows = [(b, t, v) for b in ("B", None) for t in ("T", None) for v in ("V", None)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("bb_product_id", "tv_product_id", "vo_product_id")])
    got = spark.createDataFrame(rows, schema).select(X.bundle_flag().alias("f"), X.bundle_code().alias("c")).collect()
    assert all(X.BUNDLE_BY_CODE[r.c] == r.f for r in got)
    assert len({r.c for r in got}) == 8
