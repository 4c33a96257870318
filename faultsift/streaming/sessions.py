"""Conversation sessions over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, user: str, ts: str, idle_minutes: int = 60,
                    late: str = "10 minutes") -> DataFrame:
    """Sessions that end after the idle time; events later than `late` are dropped.

    The state is one row per open session. Batch jobs use `operators.conversations.sessions`.
    """
    session = F.session_window(ts, f"{idle_minutes} minutes")
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.col(user), session)
        .agg(F.count("*").alias("n_events"), F.max(ts).alias("last_event"))
        .select(user, F.col("session_window.start").alias("session_start"), "last_event",
                "n_events")
    )
