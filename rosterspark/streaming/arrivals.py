"""A table replayed as a stream: rows arrive step by step, some of them late, and the stream goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arrivals(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the files at ``path``; what is there when it runs is one batch."""
    return spark.readStream.schema(like.schema).parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what ``stream`` gives for all that has arrived to ``path``, and read that; with the same checkpoint a later run goes on."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=path, format="parquet")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def replayed(rows: DataFrame, time: str, by: str, late: int, stream_of: Callable[[DataFrame], DataFrame], folder: str, steps: int = 4) -> DataFrame:
    """What ``stream_of`` (from a stream of ``rows`` to one that appends) gives after ``rows`` have arrived in ``steps``.

    A row arrives up to ``late`` seconds after its ``time``, by a hash of ``by``, so rows of neighbouring steps mix; rows
    with a null time arrive first. After each step the stream runs and stops, and the next run goes on from the
    checkpoint in ``folder``. At the end a heartbeat arrives, a row with nothing but a time so late that the watermark
    closes all that is open.
    """
    source, out, kept = (f"{folder}/{part}" for part in ("in", "out", "kept"))
    arrival = F.unix_micros(F.col(time)) + F.pmod(F.xxhash64(by), F.lit(late + 1)) * 1_000_000
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    last = F.timestamp_micros(F.lit((high or 0) + (1 << 42)))
    heartbeat = rows.sparkSession.range(1).select(*((last if c == time else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    step = F.coalesce(F.floor((arrival - (low or 0)) * steps / ((high or 0) - (low or 0) + 1)), F.lit(0))
    for part in (*(rows.where(step == i) for i in range(steps)), heartbeat):
        part.write.mode("append").parquet(source)
        found = run_to_end(stream_of(read_arrivals(rows.sparkSession, source, rows)), out, kept)
    return found
