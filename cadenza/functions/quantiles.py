"""Quantiles: interpolated, by nearest rank, and the sketch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(c: Column | str, q: float) -> Column:
    """Interpolated quantile of a group."""
    return F.percentile(c, F.lit(q))


def nearest(c: Column | str, q: float) -> Column:
    """The value at place round((n - 1) q), halves up, of a group's values in order.

    Held in one array per group; use it on groups of bounded size or after aggregation.
    """
    x = F.array_sort(F.collect_list(c))
    return F.get(x, F.floor((F.size(x) - 1) * q + 0.5).cast("int"))


def sketch(c: Column | str, q: float, accuracy: int = 10_000) -> Column:
    """An element near the quantile, in bounded memory."""
    return F.percentile_approx(c, q, accuracy)


def by_group(rows: DataFrame, by: list[str], value: str, qs: list[float], few: int = 500_000, parts: int = 500) -> DataFrame:
    """``by``, n, q (array of the interpolated quantiles ``qs``) of a few groups of any size; null values are left out.

    No task holds a group's values: edges from a sketch cut each group into ``parts``, the parts are counted, and only those that hold a
    wanted rank are looked at again, until they have at most ``few`` rows. Per round a few numbers for each group and quantile reach the driver.
    """
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    sizes = v.groupBy(*by).agg(F.count("*").alias("n"))
    spark, names = rows.sparkSession, ", ".join(f"{c} {sizes.schema[c].dataType.simpleString()}" for c in by)
    groups = sizes.limit(10_001).collect()
    if len(groups) > 10_000:  # many groups are small, or the data are far larger than their number
        return v.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, qs))).alias("q"))
    key = lambda r: tuple(r[c] for c in by)
    n = {key(r): r.n for r in groups}
    # wanted: (group, place) -> how many rows lie before the part that is left, and the part
    places = {(g, p) for g, m in n.items() for q in qs for p in (int((m - 1) * q), min(int((m - 1) * q) + 1, m - 1))}
    whole = (float("-inf"), float("inf"))
    left: dict[tuple, dict[tuple[float, float], int]] = {g: {whole: 0} for g in n}
    found: dict[tuple, float] = {}
    while places - found.keys():
        spans = [(*g, lo, hi) for g, x in left.items() for lo, hi in x]
        cut = spark.createDataFrame(spans, f"{names}, lo double, hi double")
        same = [v[c].eqNullSafe(cut[c]) for c in by]
        cond = (v["v"] >= cut["lo"]) & (v["v"] <= cut["hi"])
        for c in same:
            cond &= c
        inside = v.join(F.broadcast(cut), cond).select(*[v[c] for c in by], "lo", "hi", "v")  # one row a group and quantile
        told = inside.groupBy(*by, "lo", "hi").agg(F.count("*").alias("m"), F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts).alias("e")).collect()
        small = [(r, key(r)) for r in told if r.m <= few]
        if small:
            rank = Window.partitionBy(*by, "lo", "hi").orderBy("v")
            wanted = spark.createDataFrame([(*g, r.lo, r.hi, p - left[g][r.lo, r.hi]) for r, g in small for h, p in places if h == g and 0 <= p - left[g][r.lo, r.hi] < r.m], f"{names}, lo double, hi double, at long")
            ordered = inside.groupBy(*by, "lo", "hi", "v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(rank))
            cond = (ordered["lo"] == wanted["lo"]) & (ordered["hi"] == wanted["hi"]) & (wanted["at"] < ordered["upto"]) & (wanted["at"] >= ordered["upto"] - ordered["c"])
            for c in by:
                cond &= ordered[c].eqNullSafe(wanted[c])
            for r in ordered.join(F.broadcast(wanted), cond).select(*[wanted[c] for c in by], wanted["lo"], wanted["hi"], wanted["at"], ordered["v"]).collect():
                found[key(r), r.at + left[key(r)][r.lo, r.hi]] = r.v
        after: dict[tuple, dict[tuple[float, float], int]] = {}
        for r in told:
            g = key(r)
            if r.m <= few:
                continue
            edges = sorted(set(r.e))
            own = inside.where((F.col("lo") == r.lo) & (F.col("hi") == r.hi))
            for c in by:
                own = own.where(F.col(c).eqNullSafe(F.lit(r[c])))
            which = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col("v")))  # edges below the value
            counts = {x.w: x["count"] for x in own.groupBy(which.alias("w")).count().collect()}
            hits = {x.w: x["count"] for x in own.where(F.col("v").isin(edges)).groupBy(F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col("v"))).alias("w")).count().collect()}
            before = left[g][r.lo, r.hi]
            for w in range(len(edges) + 1):
                m, equal = counts.get(w, 0), hits.get(w, 0)  # values up to edge w, and those equal to it
                for h, p in places - found.keys():
                    if h == g and before <= p < before + m:
                        if p >= before + m - equal:
                            found[g, p] = edges[w]
                        else:
                            lo = math.nextafter(edges[w - 1], math.inf) if w else r.lo
                            hi = math.nextafter(edges[w], -math.inf) if w < len(edges) else r.hi
                            after.setdefault(g, {})[lo, hi] = before
                before += m
        left = after
    out = []
    for g, m in n.items():
        q = []
        for x in qs:
            p = (m - 1) * x
            a, b = found[g, int(p)], found[g, min(int(p) + 1, m - 1)]
            q.append(a + (b - a) * (p - int(p)))
        out.append((*g, m, q))
    return spark.createDataFrame(out, f"{names}, n long, q array<double>")
