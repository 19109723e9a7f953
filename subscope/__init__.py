"""subscope: subscriber analytics (churn, bundles, tenure, revenue, districts, sales)
expressed as composable PySpark DataFrame transformations.

Layout
------
- ``sources``   declared schemas, canonical table bundle, storage layout, fixture views
- ``functions`` Column expressions (key padding, bundle flag, tenure bands, ...) and their SQL versions
- ``operators`` reusable segments (churn core, district matching, sales cohort, revenue, ...)
- ``plans``     the 16 reports, segment and primitive-operator jobs, the query registry
- ``oracle``    independent DuckDB SQL for every registered query

Typical use::

    from subscope import ReportParams, configure, read_tables, reports
    t = read_tables(configure(spark), "/warehouse/subscope")
    reports.bundle_churners_by_month(t, ReportParams(year=2021)).write.parquet("/out/p01")
"""

from subscope.params import DEFAULT_PARAMS, ReportParams
from subscope.plans import reports
from subscope.session import build_session, configure
from subscope.sources.tables import Tables, from_frames, read_tables, write_tables

__all__ = [
    "DEFAULT_PARAMS",
    "ReportParams",
    "Tables",
    "build_session",
    "configure",
    "from_frames",
    "read_tables",
    "reports",
    "write_tables",
]
