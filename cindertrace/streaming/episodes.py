"""Streams of detections: at-least-once input made exact, and sessions as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(detections: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each observation once, however often it is delivered within the lateness."""
    return detections.withWatermark("acquired_at", lateness).dropDuplicatesWithinWatermark(["obs_id"])


def closed_sessions(detections: DataFrame, gap: str = "24 hours", lateness: str = "7 days") -> DataFrame:
    """One row for each place's run of detections once nothing more can join it: started_at, ended_at, n, max_frp_mw."""
    seen = detections.withWatermark("acquired_at", lateness)
    window = F.session_window("acquired_at", gap)
    return seen.groupBy("place", window.alias("w")).agg(F.count("*").alias("n"), F.max("frp_mw").alias("max_frp_mw"), F.max("acquired_at").alias("ended_at")).select("place", F.col("w.start").alias("started_at"), "ended_at", "n", "max_frp_mw")
