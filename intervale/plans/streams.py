"""Streaming queries over ``events``, run until the source is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.plans.registry import query
from intervale.streaming import events as S

US = F.unix_micros


def whole(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream in which none is late: these queries are over the whole table, in whatever order its files come."""
    path = f"{d}/events.parquet"
    return S.stream(spark, path, late=S.whole_span(spark, path))



@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by six-hour window and type, from a stream."""
    found = S.drained(spark, S.window_counts(whole(spark, d), "6 hours"), "complete")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 3 HOURS) AS end_us, count(*)::BIGINT AS n, max(value) AS max_value FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions with gaps below three hours, from a stream."""
    found = S.drained(spark, S.sessions(whole(spark, d), "3 hours"), "complete")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "max_value")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events of a stream that holds the table twice."""
    one, two = (whole(spark, d).select("event_id", "user_id", "event_type", "ts") for _ in range(2))
    twice = one.unionByName(two)
    return S.drained(spark, S.deduplicated(twice).drop("ts"), "append")


@query("SELECT o.event_id AS onset_id, e.user_id, e.event_id, e.event_type FROM events e JOIN events o ON o.user_id = e.user_id AND o.event_type = 'signup' AND e.event_type <> 'signup' AND e.ts >= o.ts AND e.ts <= o.ts + INTERVAL 12 HOURS")
def stream_onset_join(spark: SparkSession, d: str) -> DataFrame:
    """Events in the half-day after each onset, by a stream-stream join."""
    return S.drained(spark, S.after_onsets(whole(spark, d), "signup", 12), "append")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6::DOUBLE AS g FROM events)
SELECT user_id, count(g)::BIGINT AS n, round(avg(g), 2) AS mean_gap, round(stddev_pop(g) / avg(g), 4) AS cv FROM g WHERE g IS NULL OR g > 0 GROUP BY 1""")
def stream_running_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Interval statistics of each user from its state."""
    found = S.drained(spark, S.running_intervals(whole(spark, d)), "update", ["user_id"])
    return found.select("user_id", "n", F.round("mean_gap", 2).alias("mean_gap"), F.round("cv", 4).alias("cv"))
