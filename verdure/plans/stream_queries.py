"""Status streams over events, drained at once and compared with their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdure.plans.registry import query, t
from verdure.plans.table_queries import PRIORITY
from verdure.streaming import trackers


def events(spark, sf):
    schema = t(spark, sf, "events").schema.simpleString().removeprefix("struct<").removesuffix(">")
    return trackers.follow(spark, f"{sf}/events.parquet*", ", ".join(f"{k} {v}" for k, v in (x.split(":", 1) for x in schema.split(","))))


@query("stream_status_latest", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts)::VARCHAR IS NOT NULL AS seen FROM events GROUP BY 1")
def _(spark, sf):
    s = trackers.latest_state(events(spark, sf), "user_id", "event_type", "ts")
    return trackers.drained(s, f"latest_{uuid.uuid4().hex}").select("user_id", "event_type", F.col("ts").isNotNull().alias("seen"))


@query("stream_log_fold", "WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 2 ELSE 1 END AS p FROM events) SELECT user_id, arg_max(event_type, (p, ts)) AS event_type, count(*) AS n FROM p GROUP BY 1")
def _(spark, sf):
    return trackers.drained(trackers.guarded_state(events(spark, sf), "user_id", "event_type", PRIORITY, "ts"), f"fold_{uuid.uuid4().hex}")


@query("stream_activity_window", "SELECT event_type, date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    a = trackers.drained(trackers.activity(events(spark, sf), by=("event_type",)), f"activity_{uuid.uuid4().hex}")
    return a.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")
