"""Sessions and hourly activity over a stream of listens (uid, ts timestamp, is_organic, played_ratio_pct)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings


def live_sessions(stream: DataFrame, late: str = "1 hour", s: Settings = DEFAULT) -> DataFrame:
    """uid, start, end, n_events, organic_ratio of sessions that ended ``late`` before the newest event. State is one row per open session."""
    gap = F.session_window("ts", f"{s.session_gap} seconds")
    by = stream.withWatermark("ts", late).groupBy("uid", gap.alias("w")).agg(F.count("*").alias("n_events"), F.avg(F.col("is_organic").cast("double")).alias("organic_ratio"))
    return by.select("uid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "organic_ratio")


def live_activity(stream: DataFrame, every: str = "1 hour", late: str = "1 hour", s: Settings = DEFAULT) -> DataFrame:
    """start, is_organic, n_events, n_skips, n_full in tumbling windows."""
    r = F.col("played_ratio_pct")
    by = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "is_organic").agg(F.count("*").alias("n_events"), F.count_if(r < s.skip_below).alias("n_skips"), F.count_if(r >= s.full_from).alias("n_full"))
    return by.select(F.col("w.start").alias("start"), "is_organic", "n_events", "n_skips", "n_full")
