"""Months: activity, quality, growth, and the most heard artists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings
from cadenza.functions.columns import bucket, floor_bucket, labelled, percent, seconds


def activity(listens: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """month_offset (whole months), is_organic, events, unique_users."""
    month = floor_bucket(seconds(settings=s), s.month_seconds).alias("month_offset")
    by = listens.select(month, "is_organic", "uid").where(F.col("month_offset").between(0, s.last_month)).groupBy("month_offset", "is_organic")
    return by.agg(F.count("*").alias("events"), F.countDistinct("uid").alias("unique_users")).orderBy("month_offset", "is_organic")


def quality(listens: DataFrame, s: Settings = DEFAULT, mode: str = "round") -> DataFrame:
    """month_offset, is_organic, n_events, n_skips, n_full, skip_pct, full_pct of events with a play ratio.

    Months round to the nearest (the reference result); mode "floor" counts whole months as activity() does.
    """
    ratio = F.col("played_ratio_pct")
    rows = listens.where(ratio.isNotNull()).select(bucket(seconds(settings=s), s.month_seconds, mode).alias("month_offset"), "is_organic", ratio)
    out = rows.where(F.col("month_offset").between(0, s.last_month)).groupBy("month_offset", "is_organic").agg(
        F.count("*").alias("n_events"), F.count_if(ratio < s.skip_below).alias("n_skips"), F.count_if(ratio >= s.full_from).alias("n_full")
    )
    return out.withColumn("skip_pct", percent(F.col("n_skips"), F.col("n_events"))).withColumn("full_pct", percent(F.col("n_full"), F.col("n_events"))).orderBy("month_offset", "is_organic")


def growth(months: DataFrame, months_quality: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row: events of the first and last month, growth in percent, share of recommendations and skip rates of the last."""
    last = F.col("month_offset") == s.last_month
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("events"))), F.lit(0))
    a = months.agg(total(F.col("month_offset") == 0).alias("events_first"), total(last).alias("events_last"), total(last & (F.col("is_organic") == 0)).alias("__reco"))
    q = months_quality.agg(F.max(F.when(last & (F.col("is_organic") == 1), F.col("skip_pct"))).alias("last_organic_skip_pct"), F.max(F.when(last & (F.col("is_organic") == 0), F.col("skip_pct"))).alias("last_reco_skip_pct"))
    first = F.col("events_first")
    return a.join(F.broadcast(q)).select(  # one row each
        "events_first",
        "events_last",
        F.when(first > 0, (F.col("events_last") / first - 1) * 100).otherwise(0.0).alias("growth_pct"),
        (F.col("__reco") / F.greatest(F.lit(1), "events_last")).alias("reco_share_last"),
        "last_organic_skip_pct",
        "last_reco_skip_pct",
    )


def top_artists(listens: DataFrame, artist_map: DataFrame, labels: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """is_organic, place, artist_id, listens, label: the most heard artists of each kind, ties by id.

    Listens are counted per item before the map fans them out.
    """
    items = listens.groupBy("item_id", "is_organic").agg(F.count("*").alias("n"))
    artists = items.join(artist_map.where("artist_id is not null"), "item_id").groupBy("artist_id", "is_organic").agg(F.sum("n").alias("listens"))
    place = F.row_number().over(Window.partitionBy("is_organic").orderBy(F.desc("listens"), "artist_id"))
    top = artists.withColumn("place", place).where(F.col("place") <= s.top_artists)
    return top.join(labels.select("artist_id", "label"), "artist_id", "left").select("is_organic", "place", "artist_id", "listens", labelled("label", "artist_id").alias("label"))
