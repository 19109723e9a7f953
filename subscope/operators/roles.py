"""Role rows: one aggregate, several consumers, one shuffle.

Several reports need the same large aggregate of the CRM table in different
shapes (e.g. the last churn, the first churn and the bundle churns of an
account). Written as separate projections, each consumer lets Catalyst prune
the aggregate differently and push its own inferred join-key filters below
it, so the plans differ and the CRM table is aggregated (and shuffled) once
per consumer.

``stack_roles`` unpivots the aggregate into tagged rows with a ``stack``
generator whose outputs are *all* generated (no column passes through).
Generator arguments cannot be pruned and filters on generated columns cannot
be pushed below the generator, so every consumer - a filter on ``role`` and
its own projection - sits on an identical plan of the aggregate, and Spark
reuses its exchange (``ReusedExchange`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def stack_roles(df: DataFrame, roles: list[tuple[str, list[str]]], names: list[str]) -> DataFrame:
    """Unpivot ``df`` into one row per (input row, role).

    ``roles`` is a list of (role tag, SQL expressions over ``df``), each list
    as long as ``names`` and with matching types (use ``CAST(NULL AS ...)``
    for slots a role does not fill). The output columns are ``role`` and
    ``names``.
    """
    for tag, vals in roles:
        if len(vals) != len(names):
            raise ValueError(f"role {tag!r}: {len(vals)} values for {len(names)} names")
    rows = ", ".join(f"'{tag}', " + ", ".join(vals) for tag, vals in roles)
    return df.selectExpr(f"stack({len(roles)}, {rows}) AS (role, {', '.join(names)})")
