"""Boundaries of the analyses on small frames."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.config import DEFAULT
from cadenza.functions import columns, quantiles
from cadenza.operators import charts, churn, cooccur, diversity, embeddings, graph, heatmap, manifold, monthly, ranks, sessions, subset
from cadenza.plans import runner
from cadenza.sources import sinks, tables
from cadenza.streaming import live

LISTENS = "uid long, item_id long, timestamp long, is_organic short, played_ratio_pct int, track_length_seconds int"


def listens(spark, rows):
    return spark.createDataFrame([(*r, *(1, 50, 100)[len(r) - 3 :]) if len(r) < 6 else r for r in rows], LISTENS)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_buckets(spark):
    x = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,)], "x double")
    assert [r.b for r in x.select(columns.round_bucket(F.col("x"), 1).alias("b")).collect()] == [0, 2, 2, 4]
    assert [r.b for r in x.select(columns.floor_bucket(F.col("x"), 1).alias("b")).collect()] == [0, 1, 2, 3]


def test_quality_bounds(spark):
    df = listens(spark, [(1, 1, 0, 1, v, 9) for v in (None, 0, 29, 30, 79, 80, 140)])
    r = monthly.quality(df).first()
    assert (r.n_events, r.n_skips, r.n_full) == (6, 2, 2)


def test_growth_without_rows(spark):
    df = listens(spark, [])
    r = monthly.growth(monthly.activity(df), monthly.quality(df)).first()
    assert r.events_first == 0 and r.growth_pct == 0.0 and r.last_organic_skip_pct is None


def test_session_gap(spark):
    s = DEFAULT.tick_seconds
    df = listens(spark, [(10, 1, 0), (10, 2, 1800 // s), (10, 3, 1800 // s), (10, 4, (3600 + s) // s)])
    got = rows(sessions.sessions(df), "session_id", "n_events", "duration_sec")
    assert got == [(0, 3, 1800), (1, 1, 0)]


def test_lifecycle_edges(spark):
    df = spark.createDataFrame([(1, 1, s // 5, 1, 50, 9) for s in (0, 1795, 1800, 84600, 86395, 1166400, 1209595, 1209600)], LISTENS)
    cells = {(r.day_idx, r.hour): r.events for r in heatmap.lifecycle(df).collect()}
    assert sum(cells.values()) == 7  # the last second of the range is left out
    assert any(h == 24 for _, h in cells) and any(d == 14 for d, _ in cells)
    grid = heatmap.grid(heatmap.lifecycle(df), "day_idx", 14)
    assert grid.count() == 2 * 14 * 24 and grid.agg(F.max("day_idx"), F.max("hour")).first()[:] == (13, 23)


def test_net_likes(spark):
    likes = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3)], "uid long, item_id long")
    multi = spark.createDataFrame([(1, 1, "unlike"), (1, 2, "unlike"), (1, 9, "unlike"), (1, 3, "like")], "uid long, item_id long, event_type string")
    pairs = cooccur.net_pairs(likes, multi)
    assert rows(cooccur.net_likes(pairs), "item_id") == [(2,), (3,)]
    assert cooccur.net_stats(pairs).first()[:2] == (3, 1)
    assert cooccur.net_stats(pairs.where("false")).first()[:] == (0, 0, 0.0)


def test_user_band(spark):
    data = [(u, i) for u, n in ((1, 1), (2, 2), (3, 30), (4, 31)) for i in range(n)]
    df = spark.createDataFrame(data, "uid long, item_id long")
    edges = cooccur.colike_edges(df, "item_id", 30, 1)
    assert edges.agg(F.max("weight")).first()[0] == 2 and edges.count() == 30 * 29 // 2


def test_days_and_pairs(spark):
    df = listens(spark, [(10, 1, t) for t in (8639, 8640, 8641, 17280, 25920)])
    assert [r.day_bucket for r in cooccur.listening_days(df).collect()] == [0, 0, 1, 1, 2]
    two = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 1, 1), (1, 2, 1)], "uid long, item_id long, day_bucket int")
    assert rows(cooccur.colisten_edges(two, "item_id", 1), "a", "b", "weight") == [(1, 2, 1)]


def test_entropy(spark):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 5), (2, 1, 1, 10), (3, 1, 1, 4), (3, 1, 2, 4)], "uid long, is_organic short, item_id long, cnt long")
    assert rows(diversity.entropy(df), "uid", "n_unique") == [(1, 2), (2, 1)]
    assert dict(rows(diversity.entropy(df), "uid", "entropy")) == pytest.approx({1: 1.0, 2: 0.0})


def test_flat_quartiles(spark):
    h = spark.createDataFrame([(u, 1, float(u), 3) for u in range(8)], "uid long, is_organic short, entropy double, n_unique long")
    assert rows(diversity.quartile_medians(h), "quartile", "users") == [(4, 8)]


def test_rank_ties(spark):
    df = listens(spark, [(1, 7, 0), (1, 3, 0), (1, 5, 0), (2, 5, 0)])
    assert rows(ranks.track_ranks(df), "label", "item_id") == [("T1", 5), ("T2", 3), ("T3", 7)]


def churn_frame(spark):
    day = 17280
    base = [(u, u * 100 + k, k * day, 1, 50 + k % 7, 200) for u in (10, 20) for k in range(40)]
    return listens(spark, base + [(10, 1, 100 * day, 1, None, 1)])


def test_churn_bounds_and_fan_out(spark):
    df = churn_frame(spark)
    cut = churn.cutoff(df)
    assert cut == (100 - 30) * 86400
    labels = dict(rows(churn.labels(df, cut), "uid", "churn"))
    assert labels == {10: 0, 20: 1}
    items = df.select("item_id").distinct()
    double = lambda c: items.select("item_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias(c))
    one = {r.uid: r for r in churn.features(df, double("artist_id"), double("album_id"), cut).collect()}
    assert one[20].n_events == 160 and one[20].n_unique_artists == 2 and one[20].n_unique_items == 40
    dedup = churn.features(df, double("artist_id"), double("album_id"), cut, DEFAULT.__class__(churn_least=1), dedup=True).where("uid = 20").first()
    assert dedup.n_events == 40 and dedup.n_unique_albums == 2
    assert churn.cutoff(df.where("false")) is None


def test_std_of_one_event(spark):
    df = listens(spark, [(10, 1, 0, 1, None, 9), (10, 1, 40 * 17280, 1, 50, 9)])
    none = spark.createDataFrame([], "item_id long, artist_id long")
    r = churn.features(df, none, none.withColumnRenamed("artist_id", "album_id"), 10 * 86400, DEFAULT.__class__(churn_least=1)).first()
    assert r.std_played_ratio == 0.0 and r.gap_p50 == 0.0 and r.avg_played_ratio == 100.0 and r.n_unique_artists == 0


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(int(i), *map(float, rng.normal(i % 2 * 3, 1, len(churn.FEATURES))), i % 2) for i in range(200)]
    feats = spark.createDataFrame(data, "uid long, " + ", ".join(f"{c} double" for c in churn.FEATURES) + ", churn int")
    scored, weights = churn.fit(feats, trees=5)
    assert all(r.auc > 0.99 for r in churn.auc(scored).collect()) and weights.count() == len(churn.FEATURES)
    assert all(r.f1 > 0.9 for r in churn.metrics(scored).collect())
    assert churn.split(feats).where("held_out").count() == 60
    # by hand: every measure from the scores
    for name in ("forest", "logistic"):
        own = [(r.p, r.churn) for r in scored.where(F.col("model") == name).collect()]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
        assert churn.auc(scored).where(F.col("model") == name).first().auc == pytest.approx(auc)
        for r in churn.metrics(scored).where(F.col("model") == name).collect():
            tp = sum((p >= 0.5) == r["class"] == y for p, y in own)
            found, there = sum((p >= 0.5) == r["class"] for p, _ in own), sum(y == r["class"] for _, y in own)
            assert (r.precision, r.recall, r.support) == (pytest.approx(tp / found), pytest.approx(tp / there), there)
        curve = {r.p: (r.fpr, r.tpr) for r in churn.roc_points(scored).where(F.col("model") == name).collect()}
        assert curve == {p: (pytest.approx(sum(q >= p for q in neg) / len(neg)), pytest.approx(sum(q >= p for q in pos) / len(pos))) for p in {p for p, _ in own}}
    top = churn.importances(weights).collect()
    assert len(top) == 10 and [r.importance for r in top] == sorted((r.importance for r in weights.collect()), reverse=True)[:10]
    roc = churn.roc_points(scored).where("model = 'forest'").agg(F.max("fpr"), F.max("tpr")).first()
    assert roc[:] == (1.0, 1.0)


def test_graph(spark):
    cliques = [(a, b, 10) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4, 1)]
    edges = spark.createDataFrame(cliques, "a long, b long, weight long")
    parts = dict(rows(graph.louvain(edges), "node", "community"))
    assert len(set(parts.values())) == 2 and len({parts[i] for i in range(4)}) == 1
    assert rows(graph.louvain(edges), "node", "community") == rows(graph.louvain(edges), "node", "community")
    a = np.zeros((8, 8))
    for x, y, w in cliques:
        a[x, y] = a[y, x] = w
    assert graph.modularity(a, np.array([parts[i] for i in range(8)])) > graph.modularity(a, np.arange(8))
    assert dict(rows(graph.strength(edges), "node", "strength"))[3] == 31
    cells = graph.matrix_cells(edges, graph.louvain(edges))
    assert cells.count() == 2 * len(cliques)
    assert len(set(dict(rows(graph.propagate(edges), "node", "community")).values())) == 2
    assert graph.spring_layout(edges).count() == 8
    assert graph.louvain(edges.where("false")).count() == 0
    assert graph.shown(edges, 4).count() <= 6
    with pytest.raises(OverflowError):
        graph.shown(edges, 4, DEFAULT.__class__(edge_limit=5))
    named = spark.createDataFrame([(3, "T1")], "node long, label string")
    assert rows(graph.label_nodes(graph.strength(edges), named, 2), "node", "place", "label") == [(3, 1, "T1"), (4, 2, "#4")]
    with pytest.raises(OverflowError):
        sinks.guarded(edges, 3)


def test_embeddings(spark):
    v = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0]), (3, [0.0, 1.0])], "item_id long, normalized_embed array<double>")
    m = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "item_id long, artist_id long")
    assert rows(embeddings.artist_mean(v, m), "artist_id", "items", "embedding") == [(7, 2, [2.0, 4.0])]
    p = spark.createDataFrame([(i, i % 2, float(i % 2 * 10 + i), 0.0) for i in range(6)], "item_id long, community int, x double, y double")
    assert embeddings.separation(p).first().ratio > 2
    assert embeddings.separation(p.where("item_id < 4")).first().ratio == 0.0
    assert embeddings.project(v, "item_id").count() == 3
    parts, nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, community int"), spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "node long, strength long")
    assert embeddings.figure(None, "item_id", parts, nodes).count() == 0  # no vectors: left out
    assert embeddings.figure(v, "item_id", parts, nodes).count() == 0  # too few
    assert rows(embeddings.figure(v, "item_id", parts, nodes, least=3), "place", "item_id", "community") == [(1, 2, 0), (2, 1, 0), (3, 3, 1)]
    assert rows(embeddings.contrast(p), "side", "n") == [("largest", 6), ("smallest", 3)]


def test_manifold(spark):
    a, b = manifold.falloff(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 32))
    x = np.concatenate([c + r.normal(size=(30, 32)) * 0.25 for c in centres])
    own = np.repeat(range(4), 30)
    w = manifold.fuzzy(np.where(np.eye(120, dtype=bool), np.inf, np.linalg.norm(x[:, None] - x[None], axis=2)), 10)
    assert np.allclose(w, w.T) and w.min() >= 0 and w.max() <= 1 + 1e-12 and np.allclose(np.diag(w), 0)
    y = manifold.layout(x)
    assert np.array_equal(y, manifold.layout(x))
    d = np.linalg.norm(y[:, None] - y[None], axis=2) + np.where(np.eye(120, dtype=bool), np.inf, 0)
    assert (own[d.argmin(axis=1)] == own).all()  # the nearest in the plane is of the same cluster
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "item_id long, normalized_embed array<double>")
    points = manifold.project(df, "item_id").join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "item_id long, community int"), "item_id")
    assert embeddings.separation(points).first().ratio > 3
    with pytest.raises(OverflowError):
        manifold.project(df, "item_id", limit=100)
    assert manifold.project(df.limit(2), "item_id").count() == 0


@pytest.mark.parametrize("few,parts", [(500_000, 500), (40, 7), (3, 4)])
def test_quantiles_by_group(spark, few, parts):
    r = np.random.default_rng(3)
    data = [(1, float(x)) for x in r.normal(size=900)] + [(2, float(x)) for x in r.integers(0, 5, 700)] + [(None, 4.0), (3, None), (4, 1.0), (4, 2.0)] + [(5, 7.0)] * 200 + [(6, float(x)) for x in range(300)]
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x.g: (x.n, x.q) for x in quantiles.by_group(spark.createDataFrame(data, "g int, v double"), ["g"], "v", qs, few, parts).collect()}
    for g in (1, 2, None, 4, 5, 6):
        own = [v for k, v in data if k == g]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(list(np.quantile(own, qs)))
    assert set(got) == {1, 2, None, 4, 5, 6}


def test_ranks_of_equal_counts(spark):
    df = spark.range(5000).selectExpr("id * 3 AS item_id").union(spark.range(10).selectExpr("id * 300 AS item_id"))
    got = {r.item_id: r.label for r in ranks.track_ranks(df).collect()}
    order = sorted(range(0, 15000, 3), key=lambda i: (-(i % 300 == 0 and i < 3000), i))
    assert got == {x: f"T{k + 1}" for k, x in enumerate(order)}


def test_charts(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    h = charts.histogram(df, "v", 5)
    assert sum(r.n for r in h.collect()) == 11 and math.isclose(sum(r.density * (r.high - r.low) for r in h.collect()), 1)
    e = charts.edged(df, "v", charts.linear_edges(0, 10, 6))
    assert rows(e, "bin", "n") == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert charts.log_edges(100, 3) == pytest.approx([1, 10, 100])
    assert sum(r.n for r in charts.hexbin(df.withColumn("w", F.col("v")), "v", "w", (0, 10, 0, 10)).collect()) == 11
    b = charts.boxes(df.withColumn("g", F.lit(1)), "v", ["g"]).first()
    assert (b.q1, b.median, b.q3, b.low, b.high) == (2.5, 5, 7.5, 0, 10)
    q = df.agg(quantiles.nearest("v", 0.25).alias("a"), quantiles.exact("v", 0.25).alias("b"), quantiles.sketch("v", 0.5).alias("c")).first()
    assert (q.a, q.b, q.c) == (3.0, 2.5, 5.0)


def test_tables_and_subset(spark, tmp_path):
    root, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/demo"
    df = listens(spark, [(u * 10, i, i * 100) for u in range(20) for i in range(30)])
    df.write.parquet(f"{root}/listens.parquet")
    df.select("item_id", (F.col("item_id") + 1).alias("artist_id")).distinct().write.parquet(f"{root}/artist_item_mapping.parquet")
    t = tables.Tables(spark, [root])
    assert t.mode() == "full" and t.listens.count() == 600
    with pytest.raises(FileNotFoundError):
        t.path("likes")
    report = {r.name: r.status for r in t.register_views(count=True).collect()}
    assert report["listens"] == "ok" and report["likes"] == "missing"
    made = dict(rows(subset.build_subset(spark, [root], out, 5), "name", "rows"))
    assert made["listens"] == 150
    with pytest.raises(ValueError):
        tables.conform(df.drop("uid"), "listens")
    built = []
    make = lambda: built.append(1) or df
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/cache", "x", f"{root}/listens.parquet", make).count() == 600
    assert len(built) == 1
    os.utime(next((tmp_path / "raw" / "listens.parquet").glob("*.parquet")), (2e9, 2e9))  # a rewrite of equal size
    sinks.cached(spark, f"{tmp_path}/cache", "x", f"{root}/listens.parquet", make)
    assert len(built) == 2
    assert t.optional("embeddings") is None and t.optional("listens").count() == 600
    with sinks.temp_table(df, "kept_rows"):
        assert spark.sql("select count(*) from kept_rows").first()[0] == 600
    assert not spark.catalog.tableExists("kept_rows")
    ids = tables.ids_relation(spark, [10, 20])
    assert df.join(ids, "uid", "left_semi").count() == 60
    assert cooccur.sampled(df, DEFAULT.__class__(listen_users=4)).select("uid").distinct().count() == 4
    assert churn.capped(df, DEFAULT.__class__(churn_users=4)).select("uid").distinct().count() == 4
    assert subset.hash_sample(df, "uid", 3).select("uid").distinct().count() == 3
    assert sinks.guarded_size(df).count() == 600


def test_runner(spark):
    report = {r.task: r.status for r in runner.run(spark, "/nowhere", [2, 99]).collect()}
    assert report[99] == "unknown" and report[2] not in ("ok", "unknown")
    assert all(x > 0 for x in runner.memory(spark))


def test_restore_time(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 5)], "uid long, seq long, timestamp long")
    assert rows(subset.restore_time(df), "seq", "ts_seconds") == [(0, 10), (1, 25), (2, 50)]


def test_live(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(1, at(0), 1, 10), (1, at(20), 0, 90), (1, at(120), 1, 50), (2, at(600), 1, 50)], "uid long, ts timestamp, is_organic int, played_ratio_pct int")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.live_sessions(stream).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("live"), "uid", "n_events") == [(1, 1), (1, 2)]
    q = live.live_activity(stream).writeStream.format("memory").queryName("act").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("act").agg(F.sum("n_events")).first()[0] == 4


def test_separation_of_any_number(spark):
    # more points than a driver's guard lets through, in several blocks
    xy = np.random.default_rng(4).random((20_500, 2))
    c = np.arange(len(xy)) % 3
    same, other = [], []
    for i in range(0, len(xy), 500):
        d = np.sqrt(((xy[i : i + 500, None] - xy) ** 2).sum(axis=2))
        alike = c[i : i + 500, None] == c
        same.append((d * alike).sum(axis=1) / (alike.sum(axis=1) - 1))
        other.append((d * ~alike).sum(axis=1) / (~alike).sum(axis=1))
    points = spark.createDataFrame([(i, int(k), float(a), float(b)) for i, (k, (a, b)) in enumerate(zip(c, xy, strict=True))], "item_id long, community int, x double, y double")
    got = embeddings.separation(points).first()
    assert got.n == len(xy) and abs(got.ratio - np.concatenate(other).mean() / np.concatenate(same).mean()) < 1e-9


def test_separation_of_odd_points(spark):
    # nulls, copies, a key with several points and a community of one, against the SQL of the query
    from cadenza.plans.queries import ORACLES

    rows = [(1, 0, 0.0, 0.0), (2, 0, 1.0, 0.0), (3, 1, 5.0, 5.0), (4, 1, 6.0, 5.0), (4, 0, 2.0, 2.0), (4, 1, 6.0, 5.0), (5, 1, 6.0, 5.0), (6, 2, 9.0, 1.0), (7, None, 1.0, 1.0), (None, 0, 3.0, 3.0), (8, 0, None, 1.0)]
    got = embeddings.separation(spark.createDataFrame(rows, "item_id long, community int, x double, y double")).first()
    c = duckdb.connect()
    c.execute("create table embeddings (vec_id bigint, label int, embedding double[])")
    c.executemany("insert into embeddings values (?, ?, ?)", [(k, c_, [x, y]) for k, c_, x, y in rows])
    n, ratio = c.sql(ORACLES["separation_of_labels"]).fetchall()[0]
    assert (got.n, round(got.ratio, 6)) == (n, ratio)
