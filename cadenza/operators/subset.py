"""Samples, subsets and the data profile."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cadenza.config import DEFAULT, Settings
from cadenza.functions.columns import uid_bucket
from cadenza.sources.sinks import write_table
from cadenza.sources.tables import Tables


def bucket_sample(rows: DataFrame, buckets: int, keep: int = 0) -> DataFrame:
    """Rows of the users in one of ``buckets`` buckets."""
    return rows.where(uid_bucket("uid", buckets) == keep)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of the first ``n`` ids by hash: the same ids whatever the order or partitioning of the input."""
    ids = rows.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    return rows.join(ids, key, "left_semi")


def union_chunks(chunks: Iterable[DataFrame]) -> DataFrame:
    """Results of chunks as one; columns by name."""
    first, *rest = chunks
    for c in rest:
        first = first.unionByName(c)
    return first


def restore_time(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Seconds from ticks that are told as differences: running sums in a user's order. Not for absolute ticks."""
    w = Window.partitionBy("uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("ts_seconds", F.sum("timestamp").over(w) * settings.tick_seconds)


def build_subset(spark: SparkSession, roots: Iterable[str], out: str, n_users: int, settings: Settings = DEFAULT) -> DataFrame:
    """Write the tables of ``n_users`` hashed users below ``out``; a report: name, rows.

    Items are those the users listen to; an item only liked loses its mapping, as in the reference. Tables that aren't there are left out.
    """
    t = Tables(spark, roots, settings)
    users = t.listens.select("uid").distinct().orderBy(F.xxhash64(F.lit(42), "uid"), "uid").limit(n_users)
    done = []

    def put(name: str, df: DataFrame) -> DataFrame:
        got = spark.read.parquet(write_table(df, f"{out.rstrip('/')}/{name}.parquet"))
        done.append((name, got.count()))
        return got

    listens = put("listens", t.listens.join(users, "uid", "left_semi"))
    for name in ("likes", "dislikes", "multi_event"):
        try:
            put(name, t.read(name).join(users, "uid", "left_semi"))
        except FileNotFoundError:
            continue
    items = listens.select("item_id").distinct()
    for name in ("artist_item_mapping", "album_item_mapping", "embeddings"):
        try:
            put(name, t.read(name).join(items, "item_id", "left_semi"))
        except FileNotFoundError:
            continue
    return spark.createDataFrame(done, "name string, rows long")


def profile(rows: DataFrame) -> DataFrame:
    """metric, column_name, value: rows, columns, nulls by column, repeated rows, share organic, play ratios above 100. One scan and one distinct count."""
    aggs = [F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls|{c}") for c in rows.columns]]
    if "is_organic" in rows.columns:
        aggs.append(F.avg(F.col("is_organic").cast("double")).alias("organic_share"))
    if "played_ratio_pct" in rows.columns:
        aggs.append(F.count_if(F.col("played_ratio_pct") > 100).alias("ratio_above_100"))
    one = rows.agg(*aggs).join(rows.distinct().agg(F.count("*").alias("__d")))  # one row each
    pairs = [F.struct(F.lit(a.partition("|")[0]).alias("metric"), F.lit(a.partition("|")[2] or None).cast("string").alias("column"), F.col(f"`{a}`").cast("double").alias("value")) for a in one.columns if a != "__d"]
    pairs += [F.struct(F.lit("columns").alias("metric"), F.lit(None).cast("string").alias("column"), F.lit(float(len(rows.columns))).alias("value")), F.struct(F.lit("duplicate_rows").alias("metric"), F.lit(None).cast("string").alias("column"), (F.col("rows") - F.col("__d")).cast("double").alias("value"))]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.metric", F.coalesce("x.column", F.lit("")).alias("column_name"), "x.value")
