"""Windows over a stream that are closed by the watermark: sessions, and tumbling or sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_windows(events: DataFrame, time: str, key: str, gap: str, delay: str, *totals: Column) -> DataFrame:
    """(key, start, end, n, then ``totals``) of each session of a key: events at most ``gap`` apart, for append output.

    A session ends ``gap`` after its last event, and comes out once, when the watermark, ``delay`` behind the latest
    event, has passed that end; until then late events join it, or merge two sessions into one. Later events are dropped
    by Spark, which counts them. Events with a null time belong to no session; a null key has sessions of its own.
    Repeated events count each. Partial sessions are merged before the shuffle where the session asks for it
    (``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``).
    """
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, delay)
    grouped = timed.groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"), *totals)
    return grouped.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), *(c for c in grouped.columns if c not in ("session", key)))


def time_windows(events: DataFrame, time: str, key: str, width: str, slide: str, delay: str, *totals: Column) -> DataFrame:
    """(key, start, end, n, then ``totals``) of each window of a key that has events, for append output.

    Windows of ``width`` start every ``slide``; with the same length they tumble. Late events and nulls are treated as
    in ``session_windows``. An event is counted in every window that holds it.
    """
    timed = events.where(F.col(time).isNotNull()).withWatermark(time, delay)
    grouped = timed.groupBy(F.window(time, width, slide).alias("window"), key).agg(F.count(F.lit(1)).alias("n"), *totals)
    return grouped.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in grouped.columns if c not in ("window", key)))
