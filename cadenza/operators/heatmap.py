"""Heat maps: hours of the week, and the first days of a user's life."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings
from cadenza.functions.columns import bucket, seconds


def week(listens: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """is_organic, day_of_week, hour, events, avg_played_ratio."""
    t = seconds(settings=s)
    rows = listens.select("is_organic", F.floor(t % s.week_seconds / s.day_seconds).cast("int").alias("day_of_week"), F.floor(t % s.day_seconds / 3600).cast("int").alias("hour"), "played_ratio_pct")
    return rows.groupBy("is_organic", "day_of_week", "hour").agg(F.count("*").alias("events"), F.avg("played_ratio_pct").alias("avg_played_ratio"))


def lifecycle(listens: DataFrame, s: Settings = DEFAULT, mode: str = "round") -> DataFrame:
    """is_organic, day_idx, hour, events since a user's first event, within ``lifecycle_days``.

    Days and hours round to the nearest (the reference result), so day 14 and hour 24 occur; grid() leaves them out.
    """
    t = seconds(settings=s)
    first = F.min("t").over(Window.partitionBy("uid"))
    rows = listens.select("uid", "is_organic", t.alias("t")).withColumn("off", F.col("t") - first).where(F.col("off") < s.lifecycle_days * s.day_seconds)
    rows = rows.select("is_organic", bucket(F.col("off"), s.day_seconds, mode).alias("day_idx"), bucket(F.col("off") % s.day_seconds, 3600, mode).alias("hour"))
    return rows.groupBy("is_organic", "day_idx", "hour").agg(F.count("*").alias("events"))


def grid(cells: DataFrame, day: str, days: int, value: str = "events") -> DataFrame:
    """is_organic, ``day``, hour, ``value`` for all cells of days x 24 hours; missing ones are 0, those outside go."""
    spark = cells.sparkSession
    full = spark.range(2 * days * 24).select((F.col("id") % 2).cast("short").alias("is_organic"), F.floor(F.col("id") / 48).cast("int").alias(day), F.floor(F.col("id") / 2 % 24).cast("int").alias("hour"))
    got = cells.where(F.col("is_organic").isin(0, 1)).select(F.col("is_organic").cast("short").alias("is_organic"), day, "hour", F.col(value).alias("__v"), F.lit(True).alias("__is"))
    # a cell without any row is 0, one whose mean is null stays null
    return full.join(got, ["is_organic", day, "hour"], "left").withColumn(value, F.when(F.col("__is"), F.col("__v")).otherwise(0)).drop("__v", "__is")


def normalised(full: DataFrame, day: str) -> DataFrame:
    """``full`` with share: of a day's events; null on days without any."""
    total = F.sum("events").over(Window.partitionBy("is_organic", day))
    return full.withColumn("share", F.when(total > 0, F.col("events") / total))


def spread(shares: DataFrame) -> DataFrame:
    """is_organic, spread: the largest share less the smallest."""
    return shares.groupBy("is_organic").agg((F.max("share") - F.min("share")).alias("spread"))


def attention(full: DataFrame, threshold: float = 2.0) -> DataFrame:
    """night (hours 0-6), day (10-20) and whole: plain means of the grid's cells for each kind, and the verdict on both.

    ``full``: grid of avg_played_ratio.
    """
    mean = lambda c: F.avg(F.when(c, F.col("avg_played_ratio")))
    h = F.col("hour")
    by = full.groupBy("is_organic").agg(mean(h.between(0, 6)).alias("night"), mean(h.between(10, 20)).alias("day"), mean(F.lit(True)).alias("whole"))
    delta = by.agg(F.avg(F.col("night") - F.col("day")).alias("delta"))
    word = F.when(F.col("delta") > threshold, "rises at night").when(F.col("delta") < -threshold, "rises by day").otherwise("even")
    return by.join(F.broadcast(delta.withColumn("verdict", word)))  # one row
