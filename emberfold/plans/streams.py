"""Queries that replay the events table as a stream before they fold it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources.shared import scratch
from ..streaming.replay import replay
from .catalogue import ORACLE_SQL, query


def _replayed(t, keep=None):
    # A pattern, as a stream's source is a folder or a set of files; the table may be either.
    return replay(t.spark, f"{t.folder}/event[s].parquet", t.events.schema, scratch(t.spark, "replay"), keep=keep)


@query("replay_kv_latest", ORACLE_SQL["kv_latest"])
def replay_kv_latest(t):
    return L.kv_get(_replayed(t), "user_id", "value", "event_id", F.col("event_type") == "error")


@query("replay_deadline", "SELECT COUNT(*) AS n, MAX(event_id) AS last FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
def replay_deadline(t):
    log = _replayed(t, keep=F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return log.agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
