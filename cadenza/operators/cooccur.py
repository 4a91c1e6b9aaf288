"""Graphs of what occurs together: net likes, co-likes and co-listening.

Users outside a band of list lengths go before the self-join, so a user gives at most cap * (cap - 1) / 2 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings
from cadenza.functions.columns import bucket
from cadenza.operators.subset import hash_sample


def net_pairs(likes: DataFrame, multi_event: DataFrame) -> DataFrame:
    """uid, item_id, net_likes of all liked pairs: likes less unlikes."""
    up = likes.groupBy("uid", "item_id").agg(F.count("*").alias("n"))
    down = multi_event.where("event_type = 'unlike'").groupBy("uid", "item_id").agg(F.count("*").alias("m"))
    return up.join(down, ["uid", "item_id"], "left").select("uid", "item_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("net_likes"))


def net_view(pairs: DataFrame, name: str = "net_user_items") -> DataFrame:
    """The pairs with net likes as a temp view for SQL."""
    net_likes(pairs).createOrReplaceTempView(name)
    return pairs.sparkSession.table(name)


def net_likes(pairs: DataFrame) -> DataFrame:
    return pairs.where("net_likes > 0").select("uid", "item_id")


def net_stats(pairs: DataFrame) -> DataFrame:
    """total_pairs, dropped_pairs, drop_pct; zeros without pairs."""
    out = pairs.agg(F.count("*").alias("total_pairs"), F.count_if(F.col("net_likes") <= 0).alias("dropped_pairs"))
    return out.withColumn("drop_pct", F.when(F.col("total_pairs") > 0, F.col("dropped_pairs") / F.col("total_pairs") * 100).otherwise(0.0))


def with_artists(rows: DataFrame, artist_map: DataFrame, item: str = "item_id") -> DataFrame:
    """Rows with artist_id for item_id; an item of several artists gives a row for each."""
    return rows.join(artist_map.where("artist_id is not null").select("item_id", "artist_id"), item).drop(item)


def _band(rows: DataFrame, least: int, most: int) -> DataFrame:
    return rows.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("uid")


def colike_edges(pairs: DataFrame, key: str, most: int, least_weight: int) -> DataFrame:
    """a < b, weight: how many users like both. ``pairs``: uid, ``key``, repeats allowed."""
    base = pairs.select("uid", F.col(key).alias("x")).distinct()
    flat = base.join(_band(base, 2, most), "uid", "left_semi")
    pair = flat.select("uid", F.col("x").alias("a")).join(flat.select("uid", F.col("x").alias("b")), "uid").where("a < b")
    return pair.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least_weight)


def sampled(listens: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Listens of at most ``listen_users`` users, chosen by hash: for callers that want a small graph, no query takes one."""
    return hash_sample(listens, "uid", s.listen_users)


def popular(rows: DataFrame, key: str, least: int) -> DataFrame:
    """``key``, listeners: ids with at least ``least`` different users; rows without a user count for none."""
    return rows.where("uid is not null").select("uid", key).distinct().groupBy(key).agg(F.count("*").alias("listeners")).where(F.col("listeners") >= least)


def listening_days(listens: DataFrame, s: Settings = DEFAULT, mode: str = "round") -> DataFrame:
    """uid, item_id, day_bucket: days round at noon (the reference result), or are whole with mode "floor"."""
    return listens.select("uid", "item_id", bucket(F.col("timestamp").cast("long"), s.day_seconds // s.tick_seconds, mode).alias("day_bucket"))


def colisten_flat(days: DataFrame, key: str, least_popular: int, most: int) -> DataFrame:
    """Distinct uid, ``key``, day_bucket of popular ids and of users with 2 to ``most`` of them."""
    rows = days.select("uid", key, "day_bucket").distinct()
    rows = rows.join(popular(rows, key, least_popular), key, "left_semi")
    return rows.join(_band(rows.select("uid", key).distinct(), 2, most), "uid", "left_semi")


def colisten_edges(flat: DataFrame, key: str, least_weight: int) -> DataFrame:
    """a < b, weight: how many users heard both on one day."""
    one = flat.select("uid", "day_bucket", F.col(key).alias("a"))
    pair = one.join(one.withColumnRenamed("a", "b"), ["uid", "day_bucket"]).where("a < b")
    # several days of a user count once
    return pair.select("uid", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least_weight)


def warnings(popular_ids: DataFrame, flat: DataFrame, edges: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """test, n, low: whether thresholds left too little for a graph."""
    count = lambda df, name, least: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("test"), "n", (F.col("n") < least).alias("low"))
    return count(popular_ids, "popular", s.few_popular).union(count(flat, "flat", s.few_rows)).union(count(edges, "edges", s.few_edges))
