"""Popularity ranks and their labels (A1, A2, ... and T1, T2, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of ids in which places are counted.
PARTS = 64


def item_counts(listens: DataFrame) -> DataFrame:
    """item_id, listens; what both ranks need from the fact table."""
    return listens.groupBy("item_id").agg(F.count("*").alias("listens"))


def _ranked(counts: DataFrame, key: str, prefix: str) -> DataFrame:
    """Global places without one partition for all rows.

    Ids share a place range by count and by range of ids (most have been heard once, so equal counts alone would be a hot group); places are counted
    inside such a part and shifted by how many stand above.
    """
    edges = counts.agg(F.percentile_approx(key, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 20 * PARTS).alias("e")).first().e or []
    low = F.array(*[F.lit(int(x)) for x in sorted(set(edges))]) if edges else F.array().cast("array<long>")
    counts = counts.withColumn("part", F.size(F.filter(low, lambda x: x < F.col(key))))
    sizes = counts.groupBy("listens", "part").agg(F.count("*").alias("n"))
    above = sizes.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("listens"), "part")) - F.col("n")).drop("n")  # a row per distinct count and part
    own = F.row_number().over(Window.partitionBy("listens", "part").orderBy(key))
    return counts.join(above, ["listens", "part"]).select(key, "listens", F.concat(F.lit(prefix), (F.col("above") + own).cast("string")).alias("label"))


def track_ranks(listens: DataFrame) -> DataFrame:
    """item_id, listens, label; ties by id."""
    return _ranked(item_counts(listens), "item_id", "T")


def artist_ranks(listens: DataFrame, artist_map: DataFrame) -> DataFrame:
    """artist_id, listens, label. Items are counted first; an item of several artists counts for each."""
    joined = item_counts(listens).join(artist_map.where("artist_id is not null"), "item_id")
    return _ranked(joined.groupBy("artist_id").agg(F.sum("listens").alias("listens")), "artist_id", "A")
