"""Weighted undirected graphs as edge tables (a < b, weight)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings
from cadenza.functions.columns import labelled
from cadenza.sources.sinks import guarded


def strength(edges: DataFrame) -> DataFrame:
    """node, strength: the weights of a node's edges summed."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("strength"))


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """node, strength of the n strongest of the full graph; ties by id."""
    return strength(edges).orderBy(F.desc("strength"), "node").limit(n)


def shown(edges: DataFrame, n: int, s: Settings = DEFAULT) -> DataFrame:
    """The edges between the ``n`` strongest nodes; an error if the graph has more than ``edge_limit`` edges.

    All edges are kept (in memory or on disk, at most ``edge_limit``), as every figure reads them several times.
    """
    edges = guarded(edges.persist(), s.edge_limit, "graph")
    return induced(edges, top_nodes(edges, n)).persist()


def label_nodes(nodes: DataFrame, labels: DataFrame, n: int = 8) -> DataFrame:
    """node, strength, place, label of the ``n`` strongest of ``nodes`` (node, strength); ties by id. ``labels``: node, label."""
    top = nodes.orderBy(F.desc("strength"), "node").limit(n)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("strength"), "node")))  # of n rows
    return top.join(labels.select("node", "label"), "node", "left").select("node", "strength", "place", labelled("label", "node").alias("label"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges.select("a", "b", "weight")


def modularity(a: np.ndarray, part: np.ndarray) -> float:
    """Modularity of a symmetric weight matrix under a partition."""
    total = a.sum()
    if not total:
        return 0.0
    k = a.sum(axis=1)
    same = part[:, None] == part[None, :]
    return float((a[same].sum() - np.outer(k, k)[same].sum() / total) / total)


def louvain_matrix(a: np.ndarray) -> np.ndarray:
    """Communities of a symmetric weight matrix: local moves to the best gain and aggregation, in index order, until nothing gains."""
    n = len(a)
    part = np.arange(n)
    w = a.astype(float).copy()
    while True:
        size = len(w)
        own = np.arange(size)
        k, total = w.sum(axis=1), w.sum()
        if not total:
            break
        mass = k.copy()
        moved_any = True
        changed = False
        while moved_any:
            moved_any = False
            for i in range(size):
                links = np.bincount(own, weights=np.where(np.arange(size) == i, 0, w[i]), minlength=size)
                mass[own[i]] -= k[i]
                gain = links - k[i] * mass / total
                best = int(np.argmax(gain))
                if gain[best] <= gain[own[i]] + 1e-12:
                    best = own[i]
                mass[best] += k[i]
                if best != own[i]:
                    own[i], moved_any, changed = best, True, True
        if not changed:
            break
        _, own = np.unique(own, return_inverse=True)
        part = own[part]
        join = np.zeros((own.max() + 1, size))
        join[own, np.arange(size)] = 1
        w = join @ w @ join.T
    return part


def louvain(edges: DataFrame, s: Settings = DEFAULT, limit: int = 20_000) -> DataFrame:
    """node, community (0 has the most nodes, ties by smallest node) of a subgraph of bounded size.

    The induced subgraph of a few hundred nodes goes to the driver, behind a check of its size; see propagate() for more.
    """
    rows = guarded(edges, limit, "subgraph").collect()
    spark = edges.sparkSession
    nodes = sorted({x for r in rows for x in (r.a, r.b)})
    if not nodes:
        return spark.createDataFrame([], "node long, community int")
    at = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        a[at[r.a], at[r.b]] = a[at[r.b], at[r.a]] = r.weight
    part = louvain_matrix(a)
    order = sorted(set(part.tolist()), key=lambda c: (-int((part == c).sum()), int(np.flatnonzero(part == c)[0])))
    name = {c: i for i, c in enumerate(order)}
    return spark.createDataFrame([(int(v), name[int(c)]) for v, c in zip(nodes, part, strict=True)], "node long, community int")


def propagate(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation: each takes the label with the most weight around it, ties to the smallest. For graphs of any size."""
    both = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for i in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.max(F.struct("w", (-F.col("community")).alias("c"))).alias("m"))
        labels = best.select("node", (-F.col("m.c")).alias("community"))
        if i % 3 == 2 and edges.sparkSession.sparkContext.getCheckpointDir():
            labels = labels.checkpoint()
    return labels


def community_sizes(parts: DataFrame) -> DataFrame:
    """community, n, place: the largest first."""
    sizes = parts.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "community")))  # a row per community


def matrix_cells(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """i, j, weight: the symmetric matrix with nodes ordered by community and by strength in the subgraph."""
    w = Window.orderBy("place", F.desc("strength"), "node")  # of a few hundred nodes
    order = parts.join(community_sizes(parts).select("community", "place"), "community").join(strength(edges), "node", "left").fillna(0, ["strength"])
    index = order.select("node", (F.row_number().over(w) - 1).alias("i"))
    half = edges.join(index.withColumnRenamed("node", "a"), "a").join(index.select(F.col("node").alias("b"), F.col("i").alias("j")), "b").select("i", "j", "weight")
    return half.union(half.select("j", "i", "weight"))


def drawn(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with a line width and nodes (node, strength) with a size, scaled by the largest."""
    top = edges.agg(F.max("weight").alias("m"))
    most = nodes.agg(F.max("strength").alias("m"))
    e = edges.join(F.broadcast(top)).select("a", "b", "weight", (F.col("weight") / F.col("m") * 2.5 + 0.3).alias("width"))
    n = nodes.join(F.broadcast(most)).select("node", "strength", (F.col("strength") / F.col("m") * 370 + 30).alias("size"))
    return e, n


def spring_layout(edges: DataFrame, k: float = 1.2, rounds: int = 80, seed: int = 42, limit: int = 20_000) -> DataFrame:
    """node, x, y of a subgraph of bounded size: forces k**2 / d apart and weight * d**2 / k together, cooling."""
    rows = guarded(edges, limit, "subgraph").collect()
    nodes = sorted({x for r in rows for x in (r.a, r.b)})
    at = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        a[at[r.a], at[r.b]] = a[at[r.b], at[r.a]] = r.weight
    x = np.random.default_rng(seed).random((len(nodes), 2))
    for heat in np.linspace(0.1, 0.001, rounds) if len(nodes) else ():
        d = x[:, None] - x[None]
        far = np.maximum(np.linalg.norm(d, axis=2), 0.01)
        move = (d * (k * k / far**2 - a * far / k)[:, :, None]).sum(axis=1)
        x += move / np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 0.01) * heat
    return edges.sparkSession.createDataFrame([(int(v), float(p), float(q)) for v, (p, q) in zip(nodes, x, strict=True)], "node long, x double, y double")
