"""Diversity: Shannon entropy of what a user hears."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cadenza.config import DEFAULT, Settings
from cadenza.functions.quantiles import by_group


def user_counts(listens: DataFrame, key: str = "item_id", artist_map: DataFrame | None = None) -> DataFrame:
    """uid, is_organic, ``key``, cnt. With a map, items are counted first and then go to their artists."""
    items = listens.groupBy("uid", "is_organic", "item_id").agg(F.count("*").alias("cnt"))
    if artist_map is None:
        return items
    return items.join(artist_map.where("artist_id is not null"), "item_id").groupBy("uid", "is_organic", key).agg(F.sum("cnt").alias("cnt"))


def entropy(counts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """uid, is_organic, entropy (bits), n_unique for users with ``entropy_least`` events of a kind.

    One pass: log2 N - sum(c log2 c) / N.
    """
    c = F.col("cnt")
    total = F.col("total")
    out = counts.where("is_organic in (0, 1)").groupBy("uid", "is_organic").agg(F.sum("cnt").alias("total"), F.count("*").alias("n_unique"), F.sum(c * F.log2(c.cast("double"))).alias("x"))
    h = F.greatest(F.log2(total.cast("double")) - F.col("x") / total, F.lit(0.0))
    return out.where(total >= s.entropy_least).select("uid", "is_organic", h.alias("entropy"), "n_unique")


def quartiles(h: DataFrame) -> DataFrame:
    """``h`` with quartile 1 to 4 of n_unique among users of a kind.

    Edges are nearest-rank quantiles; the first three quartiles leave out their upper edge, so equal edges leave some empty.
    Edges come from counts of counts, never from a list of all users.
    """
    sizes = h.groupBy("is_organic", "n_unique").agg(F.count("*").alias("n"))
    w = Window.partitionBy("is_organic")
    sizes = sizes.withColumn("upto", F.sum("n").over(w.orderBy("n_unique"))).withColumn("all", F.sum("n").over(w))
    edge = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * q + 0.5), F.col("n_unique")))
    edges = sizes.groupBy("is_organic").agg(edge(0.25).alias("e1"), edge(0.5).alias("e2"), edge(0.75).alias("e3"))
    n = F.col("n_unique")
    which = F.when(n < F.col("e1"), 1).when(n < F.col("e2"), 2).when(n < F.col("e3"), 3).otherwise(4)
    return h.join(F.broadcast(edges), "is_organic").withColumn("quartile", which).drop("e1", "e2", "e3")


def quartile_medians(h: DataFrame) -> DataFrame:
    """is_organic, quartile, users, median_entropy."""
    # entropies are different for nearly every user, so no task may hold a group's values
    q = by_group(quartiles(h), ["is_organic", "quartile"], "entropy", [0.5])
    return q.select("is_organic", "quartile", F.col("n").alias("users"), F.col("q")[0].alias("median_entropy"))


def verdict(medians: DataFrame, threshold: float = 0.5) -> DataFrame:
    """q1, q4 (means over the kinds), grows."""
    q = lambda k: F.avg(F.when(F.col("quartile") == k, F.col("median_entropy")))
    return medians.agg(q(1).alias("q1"), q(4).alias("q4")).withColumn("grows", F.col("q4") - F.col("q1") >= threshold)
