"""Broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size of the files or of the planned rows; a written edge table grows about fivefold in memory.
BROADCAST_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """Spark's own upper estimate of a plan's size: for a written table, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Is the plan within the limit, in a session that has not switched broadcasts off?"""
    off = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    return not off and planned_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark for broadcast if the plan is within the limit; else Spark sorts and merges.

    A session that switches broadcasts off is left alone.
    """
    return F.broadcast(df) if is_small(df, limit) else df
