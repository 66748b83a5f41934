"""Residency sessions over a detection stream.

The batch rule "a gap strictly longer than ``max_gap_secs`` starts a new
event" is what ``session_window(time, gap)`` computes: a session stays open
while the next detection arrives within the gap.  With a watermark, sessions
are emitted once no more detections can extend them; state is kept per
(tag, station) and open session only.  The result has the same start, end and
count columns as the batch events (sessions are identified by their window,
not by an ordinal: numbering would need every earlier session of the group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residency_sessions(detections: DataFrame, *, max_gap_secs: int = 86_400, watermark: str = "2 days",
                       keys: Sequence[str] = ("tag_id", "station_name")) -> DataFrame:
    """Streaming (or batch) sessions per ``keys``: ``session_start``,
    ``session_end`` (window bounds), ``start_datetime``, ``end_datetime``,
    ``n_detections``.  Event time must be a zoned ``timestamp`` column
    ``datetime`` (cast NTZ values with the session zone set to UTC)."""
    d = detections
    if detections.isStreaming:
        d = d.withWatermark("datetime", watermark)
    gap = f"{int(max_gap_secs)} seconds"
    return d.groupBy(*keys, F.session_window("datetime", gap).alias("session")).agg(
        F.min("datetime").alias("start_datetime"),
        F.max("datetime").alias("end_datetime"),
        F.count(F.lit(1)).alias("n_detections"),
    ).select(*keys, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
             "start_datetime", "end_datetime", "n_detections")
