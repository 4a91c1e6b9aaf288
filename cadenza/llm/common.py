"""What the text operators share: tables, the shared folder, cut lineage and components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a folder of our own, but only if all runs in one process (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/cadenza-{name}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame, n: int = 500) -> DataFrame:
    """``df``, with Arrow batches to Python of at most ``n`` rows from now on: texts are long, and a batch is held on both sides.

    Results are computed when they are read, so the session keeps the setting; a smaller one of the caller's stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= n:
        conf.set(key, n)
    return df


def tidy() -> None:
    """Give memory that a finished task freed back to the system: Python workers live on between tasks, side by side with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # other C libraries have no such call
        return


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder; its rows come back in any order."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that saved() made, once nothing will read it again."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer used: it does so when the driver's garbage is collected."""
    for _ in range(2):  # what the first round of collection lets go of, the second sees
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)  # files are deleted in the background


def helper(df: DataFrame, name: str = "h") -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (f"_{name}{i or ''}" for i in range(len(taken) + 1)) if c.lower() not in taken)


#: Bytes of a table, as counted before, that may be broadcast.
SMALL_BYTES = 64 << 20


def fits(df: DataFrame, width: Column | int, most: int | None = None) -> bool:
    """Whether the rows of ``df``, of ``width`` bytes each, may be broadcast."""
    size = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    return size <= (SMALL_BYTES if most is None else most)


def slim(df: DataFrame, width: int = 32) -> DataFrame:
    """``df``, kept; with a hint to broadcast it if its rows, of ``width`` bytes each, may be."""
    df = cut(df)
    return F.broadcast(df) if fits(df, width) else df


#: Edges (16 bytes each) that one task may join into components.
FEW = 200_000


def _joined(edges: DataFrame) -> DataFrame:
    """Components of at most FEW edges in one task: u, v (the smallest node of its component) for every node but these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := top.setdefault(x, x)) != x:
                top[x] = top[up]
                x = top[x]
            return x

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                u, v = find(u), find(v)
                if u != v:
                    top[max(u, v)] = min(u, v)
        pairs = np.array([(x, find(x)) for x in list(top)], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): node, component_id (its smallest node).

    Alternating star contraction: every round hooks each node's larger neighbours, then its smaller ones, onto
    the smallest. Rounds go on until the edge set is what it was; once it has at most ``few`` edges, one task joins what is left. No links reach
    the driver, only a count a round. Self links, nulls and repeated links are allowed and change nothing; no links give an empty result.
    """
    few = FEW if few is None else few
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )
    n = e.count()
    while True:
        if n <= few:
            e = cut(_joined(e).repartition("u"))  # else what reads it would have one task as well
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # below each node, its smaller neighbours meet at the smallest of them
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, before, e = e, n, cut(small.where("u <> v").distinct())
        n = e.count()
        if n == before and e.join(last, ["u", "v"], "left_anti").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(e.select("v", "v").distinct())
