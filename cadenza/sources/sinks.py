"""Writing: compressed Parquet, tables built if missing, and guards before anything reaches the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cadenza.config import DEFAULT, Settings
from cadenza.sources.tables import _file, changed


def write_table(df: DataFrame, path: str) -> str:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return path


def cached(spark: SparkSession, folder: str, name: str, source: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A table built once per source: its path has the source's path, size and time of change in it, so another source never finds it, nor does a rewritten one."""
    key = hashlib.sha1(f"{source}|{_file(spark, source)}|{changed(spark, source)}".encode()).hexdigest()[:12]
    path = f"{folder.rstrip('/')}/{name}-{key}.parquet"
    if force or _file(spark, f"{path}/_SUCCESS") is None:
        write_table(build(), path)
    return spark.read.parquet(path)


def guarded(df: DataFrame, rows: int, what: str = "frame") -> DataFrame:
    """``df``, or an error if it has more than ``rows`` rows; reads no more than one row beyond."""
    if df.limit(rows + 1).count() > rows:
        raise OverflowError(f"{what} has more than {rows:,} rows")
    return df


def guarded_size(df: DataFrame, what: str = "frame", settings: Settings = DEFAULT) -> DataFrame:
    """``df``, or an error if its rows would take more than the limit on the driver (by width of its types)."""
    widths = {"long": 8, "bigint": 8, "double": 8, "int": 4, "float": 4, "smallint": 2, "boolean": 1}
    row = sum(widths.get(t, 32) for _, t in df.dtypes)
    return guarded(df, int(settings.frame_limit_gb * 1024**3 / max(row, 1)), what)


@contextmanager
def temp_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df``, kept in memory and on disk under ``name`` for SQL, while the block runs."""
    kept = df.persist()
    kept.createOrReplaceTempView(name)
    try:
        yield kept
    finally:
        df.sparkSession.catalog.dropTempView(name)
        kept.unpersist()
