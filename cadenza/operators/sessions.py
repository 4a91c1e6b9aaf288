"""Sessions by gaps, and what is told about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings
from cadenza.functions.columns import seconds, uid_bucket
from cadenza.functions.quantiles import nearest


def sessions(listens: DataFrame, s: Settings = DEFAULT, sampled: bool = False) -> DataFrame:
    """uid, session_id (from 0), n_events, duration_sec, organic_ratio, median_played_ratio, mostly_organic.

    A gap of more than ``session_gap`` seconds begins a session; equal times never part. ``sampled`` keeps every tenth user. One
    shuffle by user serves both windows and the aggregate's key.
    """
    rows = listens.where(uid_bucket("uid", s.uid_mod) == 0) if sampled else listens
    w = Window.partitionBy("uid").orderBy("ts")
    rows = rows.select("uid", seconds(settings=s).alias("ts"), "is_organic", "played_ratio_pct")
    new = (F.col("ts") - F.coalesce(F.lag("ts").over(w), "ts") > s.session_gap).cast("long")
    # the frame takes in rows of equal time, so they share a session
    rows = rows.withColumn("new", new).withColumn("session_id", F.sum("new").over(w))
    out = rows.groupBy("uid", "session_id").agg(
        F.count("*").alias("n_events"),
        (F.max("ts") - F.min("ts")).alias("duration_sec"),
        F.avg(F.col("is_organic").cast("double")).alias("organic_ratio"),
        F.median(F.col("played_ratio_pct").cast("double")).alias("median_played_ratio"),
    )
    return out.withColumn("mostly_organic", F.col("organic_ratio") >= 0.5)


def summary(sess: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """mostly_organic, sessions, medians of events, duration and play ratio, share of sessions heard in full (percent).

    Medians are taken of counts of equal values: whole events and seconds, and play ratios in halves of whole percents (the median of integers).
    """
    full = F.avg(F.when(F.col("median_played_ratio") >= s.full_from, 100.0).otherwise(0.0))
    return sess.groupBy("mostly_organic").agg(
        F.count("*").alias("sessions"), F.median("n_events").alias("median_events"), F.median("duration_sec").alias("median_duration"), F.median("median_played_ratio").alias("median_ratio"), full.alias("full_share_pct")
    )


def long_vs_short(sess: DataFrame) -> DataFrame:
    """mostly_organic, short_ratio, long_ratio: mean play ratio of sessions up to and above their kind's median length (0 without any)."""
    cut = sess.groupBy("mostly_organic").agg(F.median("n_events").alias("cut"))
    rows = sess.join(F.broadcast(cut), "mostly_organic")  # two rows at most
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("median_played_ratio"))), F.lit(0.0))
    return rows.groupBy("mostly_organic").agg(mean(F.col("n_events") <= F.col("cut")).alias("short_ratio"), mean(F.col("n_events") > F.col("cut")).alias("long_ratio"))


def verdict(parts: DataFrame, threshold: float = 1.5) -> DataFrame:
    """delta (mean difference of long and short sessions, in points) and verdict: deeper, shallower or alike."""
    delta = F.avg(F.col("long_ratio") - F.col("short_ratio"))
    word = F.when(F.col("delta") > threshold, "deeper").when(F.col("delta") < -threshold, "shallower").otherwise("alike")
    return parts.agg(delta.alias("delta")).withColumn("verdict", word)


def trimmed(sess: DataFrame, q: float = 0.99) -> DataFrame:
    """Sessions up to the quantile (nearest rank) of their kind's event counts, found on counts of counts."""
    sizes = sess.groupBy("mostly_organic", "n_events").agg(F.count("*").alias("n"))
    up = Window.partitionBy("mostly_organic").orderBy("n_events")
    all_ = Window.partitionBy("mostly_organic")
    sizes = sizes.withColumn("upto", F.sum("n").over(up)).withColumn("place", F.floor((F.sum("n").over(all_) - 1) * q + 0.5))
    limit = sizes.where("upto > place").groupBy("mostly_organic").agg(F.min("n_events").alias("limit"))
    return sess.join(F.broadcast(limit), "mostly_organic").where("n_events <= limit").drop("limit")


__all__ = ["sessions", "summary", "long_vs_short", "verdict", "trimmed", "nearest"]
