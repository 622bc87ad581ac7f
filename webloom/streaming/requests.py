"""Streaming extension: the request log and quiet periods over a stream of request events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_log(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Update-mode log per url over stream(ts, url, method, status)."""
    rows = stream.withWatermark("ts", late)
    return rows.groupBy("url").agg(F.min_by("method", "ts").alias("method"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("ts"))).alias("status"), F.count("*").alias("n"))


def busy_periods(stream: DataFrame, gap: str = "1500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of activity that end after a quiet gap: event-time form of waiting for quiescence."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "page").agg(F.count("*").alias("n")).select("page", F.col("w.start").alias("first"), F.col("w.end").alias("quiet"), "n")
