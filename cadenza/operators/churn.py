"""Churn: labels, features, correlation, models and their measures."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings
from cadenza.functions.columns import guarded_ratio, seconds
from cadenza.operators.subset import hash_sample

FEATURES = [
    "n_events", "n_unique_items", "organic_ratio", "avg_played_ratio", "std_played_ratio", "avg_track_length", "n_unique_artists", "n_unique_albums",
    "repeat_ratio", "days_since_last_event", "gap_p50", "gap_p95", "events_last_7d", "events_last_30d", "ratio_recent_7d", "trend_ratio",
]
VOLUME = ["n_events", "n_unique_items", "n_unique_artists", "n_unique_albums"]


def cutoff(listens: DataFrame, s: Settings = DEFAULT) -> int | None:
    """Last second of the data less the tail; None without rows. One number reaches the driver."""
    last = listens.agg(F.max(seconds(settings=s)).alias("t")).first().t
    return None if last is None else last - s.churn_days * s.day_seconds


def labels(listens: DataFrame, cut: int, s: Settings = DEFAULT) -> DataFrame:
    """uid, ts_max, churn: 1 for users whose last event is before ``cut``."""
    out = listens.groupBy("uid").agg(F.max(seconds(settings=s)).alias("ts_max"))
    return out.withColumn("churn", (F.col("ts_max") < cut).cast("int"))


def features(listens: DataFrame, artist_map: DataFrame, album_map: DataFrame, cut: int, s: Settings = DEFAULT, dedup: bool = False, sketch: bool = False) -> DataFrame:
    """uid, the features from events up to ``cut``, churn; for users with ``churn_least`` events.

    Items of several artists and albums multiply their events, as in the reference; ``dedup`` counts each event once.
    ``sketch`` takes approximate gap quantiles. A missing play ratio counts as heard in full. All runs in one shuffle by user:
    distinct counts are sizes of a user's sets, the label is a window over the user's rows.
    """
    day = s.day_seconds
    rows = listens.select("uid", "item_id", seconds(settings=s).alias("ts"), "is_organic", F.least("played_ratio_pct", F.lit(100)).alias("ratio"), "track_length_seconds")
    if dedup:
        grouped = lambda m, c: m.groupBy("item_id").agg(F.array_compact(F.collect_set(c)).alias(c))
        rows = rows.join(grouped(artist_map, "artist_id"), "item_id", "left").join(grouped(album_map, "album_id"), "item_id", "left")
    else:
        one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
        rows = rows.join(artist_map.select("item_id", "artist_id"), "item_id", "left").join(album_map.select("item_id", "album_id"), "item_id", "left")
        rows = rows.withColumns({c: one(c) for c in ("artist_id", "album_id")})
    user = Window.partitionBy("uid")
    rows = rows.withColumn("ts_max", F.max("ts").over(user)).where(F.col("ts") <= cut)
    rows = rows.withColumn("gap", F.col("ts") - F.lag("ts").over(user.orderBy("ts"))).withColumn("first_ts", F.min("ts").over(user))
    q = (lambda p: F.percentile_approx("gap", p, 10_000).cast("double")) if sketch else (lambda p: F.percentile("gap", F.lit(p)))
    ts = F.col("ts")
    sets = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")
    out = rows.groupBy("uid").agg(
        F.count("*").alias("n_events"),
        F.size(F.collect_set("item_id")).cast("long").alias("n_unique_items"),
        F.avg(F.col("is_organic").cast("double")).alias("organic_ratio"),
        F.avg("ratio").alias("avg_played_ratio"),
        F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)).alias("std_played_ratio"),
        F.avg("track_length_seconds").alias("avg_track_length"),
        sets("artist_id").alias("n_unique_artists"),
        sets("album_id").alias("n_unique_albums"),
        ((cut - F.max("ts")) / float(day)).alias("days_since_last_event"),
        F.coalesce(q(0.5), F.lit(0.0)).alias("gap_p50"),
        F.coalesce(q(0.95), F.lit(0.0)).alias("gap_p95"),
        F.count_if(ts.between(cut - 7 * day, cut)).alias("events_last_7d"),
        F.count_if(ts.between(cut - 30 * day, cut)).alias("events_last_30d"),
        F.count_if(ts <= F.col("first_ts") + 30 * day).alias("events_first_30d"),
        (F.max("ts_max") < cut).cast("int").alias("churn"),
    )
    out = out.where(F.col("n_events") >= s.churn_least)
    return out.withColumns({
        "repeat_ratio": F.col("n_unique_items") / F.col("n_events"),  # share of different items, whatever its name says
        "ratio_recent_7d": guarded_ratio(F.col("events_last_7d"), F.col("n_events")),
        "trend_ratio": guarded_ratio(F.col("events_last_30d"), F.col("events_first_30d")),
    })


def capped(feats: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """At most ``churn_users`` users, chosen by hash."""
    return hash_sample(feats, "uid", s.churn_users)


def _vectors(feats: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep").transform(feats.fillna(0.0, FEATURES))


def correlation(feats: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """a, b, r (Pearson; null where a feature is constant), high, both_volume for each pair of features in their order."""
    m = Correlation.corr(_vectors(feats), "x").first()[0].toArray()
    rows = [(FEATURES[i], FEATURES[j], None if np.isnan(m[i, j]) else float(m[i, j]), bool(abs(m[i, j]) > s.high_correlation), FEATURES[i] in VOLUME and FEATURES[j] in VOLUME) for i in range(len(FEATURES)) for j in range(i + 1, len(FEATURES))]
    return feats.sparkSession.createDataFrame(rows, "a string, b string, r double, high boolean, both_volume boolean")


def split(feats: DataFrame, test: float = 0.3, key: str = "uid", seed: int = 42) -> DataFrame:
    """``feats`` with held_out: within each class, the share of users that come first by hash."""
    w = Window.partitionBy("churn").orderBy(F.xxhash64(F.lit(seed), key), key)
    n = F.count("*").over(Window.partitionBy("churn"))
    return feats.withColumn("held_out", F.row_number().over(w) <= F.round(n * test))


def fit(feats: DataFrame, trees: int = 100, depth: int = 8, seed: int = 42):
    """(scored test rows: uid, churn, model, p; feature importances) of a logistic regression on scaled and a forest on raw features."""
    rows = _vectors(split(feats)).select("uid", "churn", "held_out", "x").cache()
    train, test = rows.where("not held_out"), rows.where("held_out")
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(train)
    n = max(train.count(), 1)
    lr = LogisticRegression(featuresCol="z", labelCol="churn", maxIter=500, regParam=1.0 / n, standardization=False).fit(scaler.transform(train))
    rf = RandomForestClassifier(featuresCol="x", labelCol="churn", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(train)
    out = lambda m, df, name: m.transform(df).select("uid", "churn", F.lit(name).alias("model"), vector_to_array("probability")[1].alias("p"))
    scored = out(lr, scaler.transform(test), "logistic").union(out(rf, test, "forest")).persist()  # two rows for each of at most 27,000 users
    scored.count()
    rows.unpersist()
    weights = feats.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, rf.featureImportances.toArray(), strict=True)], "feature string, importance double")
    return scored, weights


def importances(weights: DataFrame, n: int = 10) -> DataFrame:
    return weights.orderBy(F.desc("importance"), "feature").limit(n)


def roc_points(scored: DataFrame) -> DataFrame:
    """model, p, fpr, tpr: rates of rows with at least that score, one point for each distinct score."""
    at = scored.groupBy("model", "p").agg(F.sum("churn").alias("pos"), F.sum(1 - F.col("churn")).alias("neg"))
    up, all_ = Window.partitionBy("model").orderBy(F.desc("p")), Window.partitionBy("model")
    rate = lambda c: F.sum(c).over(up) / F.nullif(F.sum(c).over(all_), F.lit(0))
    return at.select("model", "p", rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def auc(scored: DataFrame) -> DataFrame:
    """model, auc by the rank formula, ties at their mean rank."""
    at = scored.groupBy("model", "p").agg(F.sum("churn").alias("pos"), F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("model").orderBy("p")) - F.col("n")
    r = at.withColumn("rank", below + (F.col("n") + 1) / 2)
    out = r.groupBy("model").agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("np"), F.sum("n").alias("n"))
    return out.select("model", F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * (F.col("n") - F.col("np"))).alias("auc"))


def metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """model, class, precision, recall, f1, support."""
    hit = (F.col("p") >= threshold).cast("int")
    c = scored.select("model", F.col("churn").alias("y"), hit.alias("h"))
    cells = c.select("model", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "y", "h").groupBy("model", "class").agg(
        F.count_if((F.col("y") == F.col("class")) & (F.col("h") == F.col("class"))).alias("tp"), F.count_if(F.col("h") == F.col("class")).alias("found"), F.count_if(F.col("y") == F.col("class")).alias("support")
    )
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("found")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return cells.select("model", "class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")
