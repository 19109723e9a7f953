"""Independent DuckDB SQL for every registered query (the correctness oracle).

traps T1-T23), in the literal CTE form: it does *not* use the rewrites of the
Spark code (conditional-minimum ties, fused aggregates, pivot-before-join),
so agreement checks those rewrites.
"""

from subscope.oracle.sql import oracle_sql

__all__ = ["oracle_sql"]
