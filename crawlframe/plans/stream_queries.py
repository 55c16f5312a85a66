"""Streaming jobs run over all events that are there, beside their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.functions.common import rnd, rnd_sql
from crawlframe.plans.registry import query
from crawlframe.sources.scratch import scratch_path
from crawlframe.streaming import jobs as J


def _events(spark, sf_dir):
    return J.read_events(spark, f"{sf_dir}/events.parquet")


_CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query(f"SELECT s AS start, user_id, n AS requests FROM (SELECT date_trunc('hour', ts) AS s, user_id, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 1 AND s + INTERVAL 1 HOUR {_CLOSED}")
def s1_request_budget(spark, sf_dir):
    """Users over their hourly budget, in closed windows."""
    return J.run_available(J.over_budget(_events(spark, sf_dir)), "s1").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"SELECT s AS start, event_type, n, {rnd_sql('total', 2)} AS total FROM (SELECT date_trunc('day', ts) AS s, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) WHERE s + INTERVAL 1 DAY {_CLOSED}")
def s4_daily_counters(spark, sf_dir):
    """Daily counters per type, in closed windows."""
    return J.run_available(J.windowed_counts(_events(spark, sf_dir)), "s4").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rnd(F.col("total"), 2).alias("total"))


@query(f"SELECT s AS start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) + to_hours(12 * k) AS s, ts, event_type FROM events, range(-1, 2) t(k)) WHERE ts >= s AND ts < s + INTERVAL 1 DAY AND s + INTERVAL 1 DAY {_CLOSED} GROUP BY 1, 2")
def s4_sliding_counters(spark, sf_dir):
    """Daily counters every twelve hours."""
    return J.run_available(J.windowed_counts(_events(spark, sf_dir), "1 day", "12 hours"), "s4-sliding").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    f"""WITH a AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS events FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR {_CLOSED}"""
)
def s5_sessions(spark, sf_dir):
    """Sessions with gaps of six hours that are over."""
    s = J.run_available(J.sessions(_events(spark, sf_dir)), "s5")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "events")


@query(
    f"""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events),
h AS (SELECT user_id, day, value, lag(value) OVER (PARTITION BY user_id ORDER BY day) AS previous, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS age FROM s WHERE r = 1)
SELECT user_id, day, {rnd_sql("value", 4)} AS value, {rnd_sql("value - previous", 4)} AS delta FROM h WHERE age <= 50"""
)
def s2_daily_snapshots(spark, sf_dir):
    """The last event of each user and day, replaced as later ones come, with the change to the day before."""
    path = scratch_path(spark, "snapshots")
    J.keep_daily_snapshots(_events(spark, sf_dir).select("event_id", "user_id", "ts", "value"), path)
    history = J.snapshot_history(spark.read.parquet(path))
    return history.select("user_id", "day", rnd(F.col("value"), 4).alias("value"), rnd(F.col("delta"), 4).alias("delta"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, ts, value, previous FROM (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events) WHERE value - previous <= -200")
def s3_drop_alerts(spark, sf_dir):
    """Events that fell by 200 or more from the user's one before."""
    daily = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts", "value")
    return J.run_available(J.drop_alerts(daily, 200.0), "s3").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
