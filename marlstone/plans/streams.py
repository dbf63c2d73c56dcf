"""Streaming queries, run over what is there; their SQL is the batch equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions.scalar import round_up
from marlstone.plans.catalog import register
from marlstone.streaming import events as ev

R4 = "floor(({}) * 10000 + 0.5) / 10000"


def _name() -> str:
    return f"s{uuid.uuid4().hex}"


def _done(stream, mode="complete"):
    return ev.run_once(stream, _name(), mode)


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("start")


@register("tumbling_counts", f"SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {R4.format('sum(value)')} AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    out = _done(ev.tumbling(ev.event_stream(spark, f"{sf}/events.parquet"), ["event_type"], "6 hours"))
    return out.select(_text("start"), "event_type", "n", round_up(F.col("total"), 4).alias("total"))


@register("sliding_counts", """
WITH b AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM events), w AS (SELECT s FROM b UNION ALL SELECT s - INTERVAL 3 HOUR FROM b) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM w GROUP BY 1""")
def sliding_counts(spark, sf):
    out = _done(ev.sliding(ev.event_stream(spark, f"{sf}/events.parquet"), [], "6 hours", "3 hours"))
    return out.select(_text("start"), "n")


@register("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, sf):
    out = _done(ev.session_counts(ev.event_stream(spark, f"{sf}/events.parquet"), "user_id", "6 hours"))
    return out.select("user_id", _text("start"), "n")


@register("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf):
    stream = ev.event_stream(spark, f"{sf}/events.parquet")
    return _done(ev.deduplicated(stream.unionByName(stream), ["event_id"]).select("event_id"), "append")


@register("stream_progress", "SELECT user_id, max(value) AS progress FROM events GROUP BY 1")
def stream_progress(spark, sf):
    out = _done(ev.progress(ev.event_stream(spark, f"{sf}/events.parquet"), "user_id", "value", 1000.0), "update")
    return out.groupBy("user_id").agg(F.max("progress").alias("progress"))
