"""Queries on the event stream's table; the same operators run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.sources.tables import table
from loamwork.streaming import log


def event_windows(spark, sf_dir):
    out = log.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


WINDOWS_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"


def pending_batches(spark, sf_dir):
    """Orders without a logged success of their customer."""
    e = table(spark, sf_dir, "events")
    entries = e.select(F.col("user_id").alias("batch_digest"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ok").otherwise("open").alias("status"), "ts")
    done = log.latest(entries)
    batches = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_digest"), "o_orderkey")
    return log.pending(batches, done)


PENDING_SQL = """WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
SELECT o_custkey AS batch_digest, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM l WHERE rn = 1 AND event_type = 'purchase')"""

QUERIES = {"event_windows": event_windows, "pending_batches": pending_batches}
ORACLES = {"event_windows": WINDOWS_SQL, "pending_batches": PENDING_SQL}
