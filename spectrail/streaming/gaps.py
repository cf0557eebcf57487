"""The one step that has a natural streaming form: clusters by gaps in time, as session windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_clusters(events: DataFrame, key: str, time: str, value: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Per key and session (a pause of at least `gap` ends it): start, end, number of events and highest value.

    Works on a stream and on a table alike; on a stream the watermark bounds the state, and events later than `late` are
    left out. Events without a time or a key are no part of a session.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    sessions = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n_events"), F.max(value).alias("highest"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "highest")
