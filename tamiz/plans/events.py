"""Queries over the event table; the same operators run on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.session import table
from tamiz.streaming import incremental


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return incremental.event_windows(table(s, d, "events"))


def user_sessions(s: SparkSession, d: str) -> DataFrame:
    return incremental.sessions(table(s, d, "events")).select("user_id", "start", "n")


QUERIES = {"event_windows": event_windows, "user_sessions": user_sessions}
SQL = {
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k",
}
