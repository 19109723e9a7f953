"""Broadcast policy: a side gets a hint only if its row count is bounded by
construction. Any other side is left to Spark's size checks (the planning
statistics against ``spark.sql.autoBroadcastJoinThreshold``, then the
materialised stage against ``spark.sql.adaptive.autoBroadcastJoinThreshold``)
and is a sort-merge join beyond them, so a catalogue that grows never
overflows an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a relation whose size is bounded by construction; the
    caller states the bound next to the call."""
    return F.broadcast(df)
