"""Oracle SQL registry: key -> full DuckDB statement (fixture prelude + body)."""

from __future__ import annotations

from subscope.oracle.prelude import PRELUDE


# reports whose table function in SQL takes arguments
CALLED = (
    "bundle_churners_by_month", "bundle_active_tenure", "bundle_churner_tenure", "mrc_non_churner_evolution",
    "district_churners", "district_churners_tenure", "district_churners_ids", "district_active_ids",
    "district_churn_rate", "district_churn_rate_by_month", "new_sales_by_channel", "new_sales_churners_by_channel",
)


def with_prelude(body: str) -> str:
    """``body`` is ``name AS (...), ... SELECT ...`` or a bare SELECT."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {PRELUDE}\n{body}"
    return f"WITH {PRELUDE},\n{body}"


def standalone(body: str) -> str:
    """The statement without the fixture prelude, for canonical tables that
    already exist under their names (e.g. a hand-made edge fixture)."""
    body = body.strip()
    return body if body.upper().startswith("SELECT") else f"WITH {body}"


def oracle_bodies() -> dict[str, str]:
    from subscope.oracle.primitives_sql import PRIMITIVE_SQL
    from subscope.oracle.reports_sql import REPORT_SQL
    from subscope.oracle.segments_sql import SEGMENT_SQL

    # the reports that are also called as SQL functions have the same oracle
    called = {f"sql_{k}": REPORT_SQL[k] for k in CALLED}
    return {**REPORT_SQL, **called, **SEGMENT_SQL, **PRIMITIVE_SQL}


def oracle_sql() -> dict[str, str]:
    return {k: with_prelude(v) for k, v in oracle_bodies().items()}
