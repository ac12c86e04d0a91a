"""The event stream: daily counts with a watermark, sessions, and upserts of repeated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of its Parquet files."""
    folder, name = sf_dir, "events.parquet"
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zone


def daily(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Number and sum of values by day and type; a stream leaves out events later than the watermark (None: it has one)."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("date").alias("date"), "event_type", "n", "total")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Repeated events by id once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events that are less than the gap apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
