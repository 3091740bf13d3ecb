"""Queries over events: sliding admission (parity), windows and sessions (an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import windows as w
from .registry import query


@query("sm_01", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events")
def sm_01(spark, sf_dir):
    """Events of a user in the six hours up to each."""
    return w.admitted(table(spark, sf_dir, "events"), "user_id", "ts", 21_600, 3).select("event_id", "recent")


@query("sm_03", "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def sm_03(spark, sf_dir):
    """Daily windows by type (an extension)."""
    found = w.counts(table(spark, sf_dir, "events"), "ts", "1 day", "event_type")
    return found.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sm_03_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o >= INTERVAL 3600 SECOND OR lag(ts) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM y GROUP BY user_id, s")
def sm_03_sessions(spark, sf_dir):
    """Sessions that end after an hour without events (an extension)."""
    return w.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour").select("user_id", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "n")
