"""Registered queries: streams over the event and line-item tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import run, tasks
from . import views
from .queries import _query

KNOWN = ("click", "view", "purchase")


@_query("SELECT event_id AS task_id, event_type AS type, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS handler, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'PENDING' ELSE 'FAILED' END AS status FROM events", False)
def task_routes(s: SparkSession, d: str) -> DataFrame:
    stream = run.file_stream(s, d, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("type"))
    return run.finished(tasks.route(stream, KNOWN), "routes")


@_query("SELECT user_id, max(ts) AS ts, max(event_id) AS event_id FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY 1", False)
def latest_events(s: SparkSession, d: str) -> DataFrame:
    stream = run.file_stream(s, d, "events").select("user_id", "ts", "event_id")
    return run.finished(stream, "latest", keys=["user_id"], newest=["ts", "event_id"])


@_query("SELECT DISTINCT l_orderkey AS task_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", False)
def unhandled_tasks(s: SparkSession, d: str) -> DataFrame:
    done = views.work(s, d).filter("status = 'COMPLETED'")
    return tasks.unhandled(views.table(s, d, "lineitem").select(F.col("l_orderkey").alias("task_id")), done)


@_query("SELECT user_id, window_start, hits <= 3 AS allowed, CASE WHEN hits > 3 THEN CAST(greatest(epoch(window_start) + 86400 - epoch(TIMESTAMP '2024-01-15 12:00:00'), 1) AS BIGINT) END AS retry_after FROM (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS hits FROM events GROUP BY 1, 2)", False)
def rate_limit_answers(s: SparkSession, d: str) -> DataFrame:
    counts = tasks.window_counts(views.table(s, d, "events"))
    return tasks.allowed(counts, now="2024-01-15 12:00:00").select("user_id", "window_start", "allowed", "retry_after")


@_query("SELECT l_orderkey * 10 + l_linenumber AS payment_id, CAST(l_orderkey AS VARCHAR) AS reference, o_orderkey AS invoice_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate + INTERVAL 30 DAYS AND o_orderdate >= l_shipdate - INTERVAL 3650 DAYS", False)
def bound_payments(s: SparkSession, d: str) -> DataFrame:
    key, order = F.col("l_orderkey"), F.col("o_orderkey")
    paid = run.file_stream(s, d, "lineitem").select((key * 10 + F.col("l_linenumber")).alias("payment_id"), (key % 5).alias("business_id"), key.cast("string").alias("reference"), F.col("l_shipdate").cast("timestamp").alias("paid_at"))
    made = run.file_stream(s, d, "orders").select(order.alias("invoice_id"), (order % 5).alias("business_id"), order.cast("string").alias("number"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return run.finished(tasks.bind_late(paid, made, how="inner"), "bound")
