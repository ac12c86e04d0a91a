"""Registered queries that run a stream over a table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaywise.plans.queries import query
from quaywise.session import shared_folder
from quaywise.streaming import events, lifetimes

#: How long a value is valid after its last sign, and how late signs may come.
SECONDS, LATE = 6 * 3600, "1 day"


@query(
    """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS g FROM e),
t AS (SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, max(ts) + INTERVAL 6 HOUR AS expires_at, count(*) AS n, max({'at': ts, 'v': event_type}).v AS value FROM s GROUP BY user_id, g)
SELECT * FROM t WHERE epoch_ms(expires_at) < (SELECT epoch_ms(max(ts)) - 86400000 FROM events)"""
)
def event_lifetimes(spark, d):
    """The stretches in which a user's last event was valid, of all events as a stream: state by user, ended by the watermark."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    found = lifetimes.of_stream(events.stream(spark, d), ["user_id"], "ts", F.col("event_type"), SECONDS, LATE)
    writer = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at", "expires_at")})
