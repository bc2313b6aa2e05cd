"""Streams with timers over events, held against what the whole table says."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.tables import table
from quire.streaming import stateful, timers

HOUR = 3_600_000
#: DuckDB: what the watermark, two days behind the newest event, has passed.
PASSED = "epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM events) - 2 * 24 * 3600000"


def _answered(spark: SparkSession, sf_dir: str, step: timers.Step) -> DataFrame:
    still = table(spark, sf_dir, "events")
    events = stateful.event_stream(spark, f"{sf_dir}/events.parquet", still.schema)
    work = timers.answered(events, "user_id", "ts", "event_id", F.col("event_type") == "error", step, "2 days")
    return stateful.drained(work, f"timers_{uuid.uuid4().hex}")


@query(f"""
SELECT user_id AS key, event_id AS event, coalesce(epoch_ms(ts) < max(CASE WHEN event_type = 'error' THEN epoch_ms(ts) END) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) + 40 * {HOUR}, false) AS ok
FROM events WHERE {PASSED}
""")
def revoked_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error revokes its user for forty hours; which events come while it does."""
    return _answered(spark, sf_dir, timers.revocation(40 * HOUR))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS event, epoch_ms(ts) AS at_, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events WHERE {PASSED}),
f AS (SELECT key, event, n, true AS ok, at_ + 100 * {HOUR} AS until FROM e WHERE n = 1
 UNION ALL SELECT e.key, e.event, e.n, e.at_ >= f.until, CASE WHEN e.at_ < f.until THEN f.until ELSE e.at_ + 100 * {HOUR} END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT key, event, ok FROM f
""")
def in_flight_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user within a hundred hours of the last one that was let through are one with it."""
    return _answered(spark, sf_dir, timers.in_flight(100 * HOUR))
