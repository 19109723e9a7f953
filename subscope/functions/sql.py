"""The scalar helpers as SQL functions, for users who query the canonical
tables with ``spark.sql`` (as the reports' own SQL text does with its
accent-folding function).

The bodies are built-in SQL expressions (``CREATE TEMPORARY FUNCTION ...
RETURN``): the analyzer inlines them, so they run inside whole-stage codegen
exactly like the Column versions in :mod:`subscope.functions.exprs`, with no
Python involved. They are generated from the same fixed values.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from subscope.functions import exprs as X


_q = X.quoted


def _bands(arg: str, bands) -> str:
    whens = [f"WHEN {arg} <= {b} THEN {_q(label)}" if b is not None else f"WHEN {arg} IS NOT NULL THEN {_q(label)}"
             for b, label in bands]
    return "CASE " + " ".join(whens) + " END"


def _bundle() -> str:
    owned = [f"CAST({x} IS NOT NULL AS INT)" for x in ("bb", "tv", "vo")]
    labels = ", ".join(_q(X.BUNDLE_BY_CODE[code]) for code in range(8))
    return f"array({labels})[4 * {owned[0]} + 2 * {owned[1]} + {owned[2]}]"


def definitions() -> dict[str, str]:
    """name -> CREATE statement."""
    fill = X.KEY_FILL * X.KEY_WIDTH
    months = " ".join(f"WHEN m = {i} THEN {_q(n)}" for i, n in enumerate(X.MONTH_NAMES_ES, 1))
    fns = {
        "pad_contract_key": ("x STRING", "STRING", f"right(concat({_q(fill)}, x), {X.KEY_WIDTH})"),
        "strip_acute_accents": ("word STRING", "STRING", f"translate(word, {_q(X.ACCENTED)}, {_q(X.UNACCENTED)})"),
        "bundle_flag": ("bb STRING, tv STRING, vo STRING", "STRING", _bundle()),
        "tenure_band_14": ("age DOUBLE", "STRING", _bands("age", X.TENURE_14)),
        "tenure_band_4": ("age DOUBLE", "STRING", _bands("age", X.TENURE_4)),
        "tenure_band_3": ("age DOUBLE", "STRING", _bands("age", X.TENURE_3)),
        "calendar_month_diff": ("later DATE, earlier DATE", "INT",
                                "(year(later) - year(earlier)) * 12 + (month(later) - month(earlier))"),
        "month_name_es": ("m INT", "STRING", f"CASE {months} END"),
        "trend_label": ("earlier DOUBLE, later DOUBLE", "STRING",
                        f"CASE WHEN earlier IS NULL OR later IS NULL THEN NULL WHEN earlier > later THEN {_q(X.WENT_DOWN)} "
                        f"WHEN earlier = later THEN {_q(X.SAME)} ELSE {_q(X.WENT_UP)} END"),
        "relative_change": ("earlier DOUBLE, later DOUBLE", "DOUBLE", "later / nullif(earlier, 0D) - 1"),
    }
    return {
        name: f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}"
        for name, (args, ret, body) in fns.items()
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register every helper as a temporary SQL function of the session."""
    for stmt in definitions().values():
        spark.sql(stmt)
    return list(definitions())
