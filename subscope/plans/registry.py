"""Query registry: one callable (spark, sf_dir) -> DataFrame per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subscope.params import DEFAULT_PARAMS
from subscope.sources.fixtures import fixture_tables

QueryFn = Callable[[SparkSession, str], DataFrame]


def _bind(builder) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return builder(fixture_tables(spark, sf_dir), DEFAULT_PARAMS)

    run.__name__ = getattr(builder, "__name__", "query")
    run.__doc__ = builder.__doc__
    return run


def builders() -> dict:
    """key -> builder(Tables, ReportParams) for every registered query."""
    from subscope.plans.primitives import PRIMITIVES
    from subscope.plans.reports import REPORTS
    from subscope.plans.segments import SEGMENTS
    from subscope.plans.sql_reports import SQL_REPORTS

    return {**REPORTS, **SQL_REPORTS, **SEGMENTS, **PRIMITIVES}


def queries() -> dict[str, QueryFn]:
    return {k: _bind(f) for k, f in builders().items()}
