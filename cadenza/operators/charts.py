"""Data of charts: bins, curves and boxes as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.quantiles import by_group


def histogram(rows: DataFrame, value: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """by, bin, low, high, n, density in ``bins`` equal bins between the smallest and largest value of a group; the last takes in its upper edge."""
    by = by or []
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    edge = v.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("all"))
    v = v.join(edge, by) if by else v.join(F.broadcast(edge))  # one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    out = v.withColumn("w", width).withColumn("bin", at).groupBy(*by, "bin", "lo", "w", "all").agg(F.count("*").alias("n"))
    low = F.col("lo") + F.col("bin") * F.col("w")
    return out.select(*by, "bin", low.alias("low"), (low + F.col("w")).alias("high"), "n", (F.col("n") / (F.col("all") * F.col("w"))).alias("density"))


def edged(rows: DataFrame, value: str, edges: list[float], by: list[str] | None = None) -> DataFrame:
    """by, bin, low, high, n, density between given edges; values outside are left out."""
    by = by or []
    e = F.array(*map(F.lit, edges))
    v = F.col(value).cast("double")
    # places of edges are found by counting those not above the value
    at = F.least(F.size(F.filter(e, lambda x: x <= v)) - 1, F.lit(len(edges) - 2))
    inside = rows.where(F.col(value).between(edges[0], edges[-1])).select(*by, at.alias("bin"))
    n = inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    total = inside.groupBy(*by).agg(F.count("*").alias("all"))
    n = n.join(total, by) if by else n.join(F.broadcast(total))  # one row
    low, high = F.get(e, F.col("bin")), F.get(e, F.col("bin") + 1)
    return n.select(*by, "bin", low.alias("low"), high.alias("high"), "n", (F.col("n") / (F.col("all") * (high - low))).alias("density"))


def log_edges(highest: float, n: int = 60) -> list[float]:
    """n edges from 1 to ``highest``, evenly spaced by logarithm."""
    top = math.log10(max(highest, 1.0000001))
    return [10 ** (top * i / (n - 1)) for i in range(n)]


def linear_edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def hexbin(rows: DataFrame, x: str, y: str, extent: tuple[float, float, float, float], size: int = 40, by: list[str] | None = None) -> DataFrame:
    """by, cx, cy, n, log_n: counts at the nearest centre of two shifted lattices of ``size`` columns."""
    by = by or []
    x0, x1, y0, y1 = extent
    ny = max(1, int(size / math.sqrt(3)))
    sx, sy = (x1 - x0) / size or 1.0, (y1 - y0) / ny or 1.0
    u, v = (F.col(x) - x0) / sx, (F.col(y) - y0) / sy
    i1, j1 = F.rint(u), F.rint(v)
    i2, j2 = F.floor(u).cast("double"), F.floor(v).cast("double")
    d1 = (u - i1) ** 2 + 3 * (v - j1) ** 2
    d2 = (u - i2 - 0.5) ** 2 + 3 * (v - j2 - 0.5) ** 2
    near: Column = d1 < d2
    cells = rows.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).select(*by, (F.when(near, i1).otherwise(i2 + 0.5) * sx + x0).alias("cx"), (F.when(near, j1).otherwise(j2 + 0.5) * sy + y0).alias("cy"))
    return cells.groupBy(*by, "cx", "cy").agg(F.count("*").alias("n")).withColumn("log_n", F.log10("n"))


def boxes(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, q1, median, q3, low, high: whiskers end at the last values within 1.5 interquartile ranges."""
    q = by_group(rows, by, value, [0.25, 0.5, 0.75])
    q = q.select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = rows.join(q, by)
    low = F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value)))
    high = F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value)))
    return v.groupBy(*by, "n", "q1", "median", "q3").agg(low.alias("low"), high.alias("high"))
