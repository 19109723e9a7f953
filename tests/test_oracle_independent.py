"""The oracle shares nothing with the code it checks."""

import ast
import pathlib

import pytest

from subscope.functions import exprs as X
from subscope.oracle.compare import duck_result, same, spark_result
from subscope.oracle.sql import oracle_bodies, standalone
from subscope.params import DEFAULT_PARAMS
from subscope.plans.registry import builders


def test_no_import_of_the_checked_code():
    for path in pathlib.Path(X.__file__).parents[1].joinpath("oracle").glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [
                a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not [n for n in names if n.startswith("subscope") and not n.startswith("subscope.oracle")], path


@pytest.mark.parametrize("name, value, key", [
    ("KEY_WIDTH", 9, "pad_contract_key"),
    ("UNACCENTED", "aeioo", "strip_acute_accents"),
    ("TENURE_3", ((2, "3M"), (6, "3M-6M"), (None, "6M+")), "active_month_tenure"),
    ("NON_PAYMENT", "MOROSO", "disconnect_reason_split"),
    ("BUNDLE_BY_CODE", {**X.BUNDLE_BY_CODE, 4: "1P - X"}, "bundle_flag"),
    ("SAME", "EQUAL", "charge_trend"),
])
def test_a_wrong_constant_turns_a_row_red(monkeypatch, edge, duck_edge, name, value, key):
    if key == "strip_acute_accents":
        from pyspark.sql import functions as F

        edge = type(edge)(**{**edge.__dict__, "districts": edge.districts.withColumn("district", F.lit("Perú"))})
        duck_edge.execute("CREATE OR REPLACE TEMP VIEW dd AS SELECT * REPLACE ('Perú' AS district) FROM district_index")
        sql = standalone(oracle_bodies()[key]).replace("district_index", "dd")
    else:
        sql = standalone(oracle_bodies()[key])
    want = duck_result(duck_edge, sql)
    ok, why = same(spark_result(builders()[key](edge, DEFAULT_PARAMS)), want)
    assert ok, why
    monkeypatch.setattr(X, name, value)
    ok, _ = same(spark_result(builders()[key](edge, DEFAULT_PARAMS)), want)
    assert not ok
