"""Embeddings of items and artists: loading, means, a projection and how well communities part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import manifold
from cadenza.sources.sinks import guarded


def for_items(vectors: DataFrame, items: DataFrame) -> DataFrame:
    """Vectors of the given item_ids."""
    return vectors.join(items.select("item_id").distinct(), "item_id", "left_semi")


def artist_mean(vectors: DataFrame, artist_map: DataFrame, vector: str = "normalized_embed") -> DataFrame:
    """artist_id, items, embedding: the element-wise mean over an artist's items."""
    rows = vectors.join(artist_map.where("artist_id is not null"), "item_id").select("artist_id", "item_id", F.posexplode(vector).alias("p", "v"))
    mean = rows.groupBy("artist_id", "p").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    # one entry for each dimension
    return mean.groupBy("artist_id").agg(F.max("n").alias("items"), F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("embedding"))


def project(vectors: DataFrame, key: str, vector: str = "normalized_embed") -> DataFrame:
    """``key``, x, y: the first two principal components of vectors of length one, for any number of them."""
    v = vectors.select(key, array_to_vector(F.col(vector)).alias("raw"))
    v = Normalizer(inputCol="raw", outputCol="unit").transform(v)
    out = PCA(k=2, inputCol="unit", outputCol="two").fit(v).transform(v)
    return out.select(key, vector_to_array("two").alias("two")).select(key, F.col("two")[0].alias("x"), F.col("two")[1].alias("y"))


def figure(vectors: DataFrame | None, key: str, parts: DataFrame, nodes: DataFrame, least: int = 5, vector: str = "normalized_embed", method: Callable[..., DataFrame] = manifold.project) -> DataFrame:
    """``key``, community, x, y, place (by strength): the projection of the shown nodes that have a vector, by ``method`` (the manifold's, or project() for principal components).

    Empty without vectors (the stage is left out) and below ``least`` points. ``parts``: node, community; ``nodes``: node, strength.
    """
    schema = f"{key} long, community int, x double, y double, place int"
    spark = parts.sparkSession
    if vectors is None:
        return spark.createDataFrame([], schema)
    own = vectors.join(guarded(parts, 20_000, "figure").select(F.col("node").alias(key)), key, "left_semi")
    if own.limit(least).count() < least:
        return spark.createDataFrame([], schema)
    by = F.row_number().over(Window.orderBy(F.desc("strength"), key))  # of a few hundred nodes
    told = parts.join(nodes.select("node", "strength"), "node", "left").withColumnRenamed("node", key)
    return method(own, key, vector).join(told, key).select(F.col(key).cast("long"), F.col("community").cast("int"), "x", "y", by.alias("place"))


def contrast(points: DataFrame) -> DataFrame:
    """side (smallest, largest), n, x, y: the centre of the smallest community and that of the points of the two largest; ties by number."""
    sizes = points.groupBy("community").agg(F.count("*").alias("n"))
    up, down = Window.orderBy("n", "community"), Window.orderBy(F.desc("n"), "community")  # a row per community
    sides = sizes.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down))
    sides = sides.select("community", F.explode(F.array_compact(F.array(F.when(F.col("up") == 1, "smallest"), F.when(F.col("down") <= 2, "largest")))).alias("side"))
    return points.join(sides, "community").groupBy("side").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def centroids(points: DataFrame) -> DataFrame:
    """community, n, x, y."""
    return points.groupBy("community").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


#: Points in a block, and bytes of blocks that may be broadcast.
BLOCK, SMALL = 4096, 64 << 20


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each point of block p the weighted sums of its distances to block q, and their weights: in its community and outside."""
    for b in batches:
        for own, other in zip(b.column("p"), b.column("q"), strict=True):
            (c, x, y, _), (c2, x2, y2, w) = ([col.to_numpy(zero_copy_only=False) for col in side.values.flatten()] for side in (own, other))
            order = np.argsort(c2, kind="stable")
            c2, x2, y2, w = c2[order], x2[order], y2[order], w[order].astype(float)
            kinds, first = np.unique(c2, return_index=True)
            weight = np.add.reduceat(w, first)
            at = np.minimum(np.searchsorted(kinds, c), len(kinds) - 1)
            met = kinds[at] == c  # whether the community has points there
            out = np.zeros((4, len(c)))
            out[1] = np.where(met, weight[at], 0)
            out[3] = weight.sum() - out[1]
            for k in range(0, len(c), 64):
                part = slice(k, k + 64)
                d = np.sqrt((x[part, None] - x2) ** 2 + (y[part, None] - y2) ** 2)
                sums = np.add.reduceat(d * w, first, axis=1)
                rows = np.flatnonzero(met[part])
                out[0, part][rows] = sums[rows, at[part][rows]]
                sums[rows, at[part][rows]] = 0
                out[2, part] = sums.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(x), pa.array(y), *(pa.array(v) for v in out)], names=["c", "x", "y", "s", "ns", "o", "no"])


def separation(points: DataFrame, key: str = "item_id") -> DataFrame:
    """n, ratio: mean over points of the mean distance to other communities, by that to the own. 0 below 5 points or without a side.

    ``points``: key, community, x, y; any number, the time is its square: blocks of different points meet all blocks. Rows with a null meet none, nor
    do rows of one key.
    """
    p = points.select(F.col(key).alias("k"), F.col("community").alias("c"), F.col("x").cast("double"), F.col("y").cast("double")).dropna()
    p = p.groupBy("k", "c", "x", "y").agg(F.count("*").alias("w"))
    # points at one place are one of that weight
    place = p.groupBy("c", "x", "y").agg(F.sum("w").alias("w"))
    n_blocks = -(-place.count() // BLOCK) or 1
    blocks = place.groupBy(F.pmod(F.xxhash64("c", "x", "y"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(F.struct("c", "x", "y", "w")).alias("p"))
    q = blocks.select(F.col("p").alias("q"))
    pairs = blocks.select("p").repartition(n_blocks).crossJoin(F.broadcast(q) if n_blocks * BLOCK * 40 <= SMALL else q)
    kind = dict(place.dtypes)["c"]
    sums = pairs.mapInArrow(_distances, f"c {kind}, x double, y double, s double, ns double, o double, no double").groupBy("c", "x", "y").agg(*[F.sum(c).alias(c) for c in ("s", "ns", "o", "no")])
    # what rows of one key have among themselves goes off again
    twin = p.join(p.select("k", F.col("c").alias("c2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2")), "k")
    n, d, same = F.col("w") * F.col("w2"), F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2), F.col("c") == F.col("c2")
    own = {"s": F.when(same, n * d), "ns": F.when(same, n), "o": F.when(~same, n * d), "no": F.when(~same, n)}
    own = twin.groupBy("k").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"own_{c}") for c, v in own.items()])
    each = p.join(sums, ["c", "x", "y"]).groupBy("k").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("s", "ns", "o", "no")]).join(own, "k")
    mean = lambda s, m: F.avg(F.when(F.col(m) > F.col(f"own_{m}"), (F.col(s) - F.col(f"own_{s}")) / (F.col(m) - F.col(f"own_{m}"))))
    means = each.agg(mean("o", "no").alias("other"), mean("s", "ns").alias("same"))
    n = points.agg(F.count("*").alias("n"))
    ok = (F.col("n") >= 5) & F.col("other").isNotNull() & F.col("same").isNotNull()
    return n.join(F.broadcast(means)).select("n", F.when(ok, F.col("other") / F.greatest("same", F.lit(1e-9))).otherwise(0.0).alias("ratio"))
