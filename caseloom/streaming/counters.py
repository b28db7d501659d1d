"""Streams of events: windowed counts and rule hits with watermarks. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, keys: list[str], width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """(start, keys, n, people) in fixed windows; later events than the watermark are dropped from a stream."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = own.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.approx_count_distinct("person_id").alias("people"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "people")


def visits(events: DataFrame, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(person_id, location_id, start, end, n): stays, ended by a gap without events."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = own.groupBy(F.session_window(ts, gap).alias("w"), "person_id", "location_id").agg(F.count("*").alias("n"))
    return out.select("person_id", "location_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def off_hours(events: DataFrame, ts: str) -> DataFrame:
    return events.where(F.coalesce(F.hour(ts), F.lit(12)).isin(1, 2, 3, 4))
