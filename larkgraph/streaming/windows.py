"""Sliding admission and windows, as batch queries and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admitted(events: DataFrame, user: str, ts: str, seconds: int, most: int) -> DataFrame:
    """``events`` with ``recent``, those of the user in the seconds up to each (itself included), and ``admitted``."""
    span = Window.partitionBy(user).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(span)).withColumn("admitted", F.col("recent") <= most)


def counts(events: DataFrame, ts: str, width: str, *keys: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by window and keys, of a table or of a stream (``late``: how long to wait for events)."""
    source = events.withWatermark(ts, late) if late else events
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return source.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, user: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user that end after a gap."""
    source = events.withWatermark(ts, late) if late else events
    return source.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), "n")
