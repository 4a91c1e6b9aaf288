"""Where tables come from: a resolver over several roots, typed readers, catalog views and adapters for the test tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.config import DEFAULT, Settings

LONG, SHORT, INT, STRING = T.LongType(), T.ShortType(), T.IntegerType(), T.StringType()
EVENT = {"uid": LONG, "item_id": LONG, "timestamp": LONG, "is_organic": SHORT}
#: Columns each table must have, with the types they are read as.
SCHEMAS: dict[str, dict[str, T.DataType]] = {
    "listens": EVENT | {"played_ratio_pct": INT, "track_length_seconds": INT},
    "likes": EVENT,
    "dislikes": EVENT,
    "multi_event": {"uid": LONG, "item_id": LONG, "event_type": STRING},
    "artist_item_mapping": {"item_id": LONG, "artist_id": LONG},
    "album_item_mapping": {"item_id": LONG, "album_id": LONG},
    "embeddings": {"item_id": LONG, "normalized_embed": T.ArrayType(T.DoubleType())},
}
VIEWS = tuple(SCHEMAS)


def _file(spark: SparkSession, path: str) -> int | None:
    """Bytes below ``path`` on any file system Spark knows, None if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def changed(spark: SparkSession, path: str) -> int | None:
    """When ``path`` or the newest file below it was written (milliseconds), None if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    newest, files = fs.getFileStatus(p).getModificationTime(), fs.listFiles(p, True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest


def find_table(spark: SparkSession, roots: Iterable[str], name: str, settings: Settings = DEFAULT) -> str:
    """Path of NAME.parquet under the first root that has it in more than ``least_file_bytes``."""
    tried = [f"{root.rstrip('/')}/{name}.parquet" for root in roots]
    for path in tried:
        if (_file(spark, path) or 0) > settings.least_file_bytes:
            return path
    raise FileNotFoundError(f"{name}: none of {', '.join(tried)}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Check that a table has its columns and cast them to their types; other columns stay."""
    want = SCHEMAS[name]
    if missing := [c for c in want if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[F.col(c).cast(want[c]).alias(c) if c in want else F.col(c) for c in df.columns])


class Tables:
    """Lazy readers: Tables(spark, roots).listens and so on."""

    def __init__(self, spark: SparkSession, roots: Iterable[str], settings: Settings = DEFAULT):
        self.spark, self.roots, self.settings = spark, list(roots), settings

    def path(self, name: str) -> str:
        return find_table(self.spark, self.roots, name, self.settings)

    def read(self, name: str) -> DataFrame:
        return conform(self.spark.read.parquet(self.path(name)), name)

    def optional(self, name: str) -> DataFrame | None:
        """A table whose analyses are left out where it is missing."""
        try:
            return self.read(name)
        except FileNotFoundError:
            return None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.read(name)

    def mode(self) -> str:
        """"full" if the first root has the listens, else "demo"."""
        return "full" if (_file(self.spark, f"{self.roots[0].rstrip('/')}/listens.parquet") or 0) > self.settings.least_file_bytes else "demo"

    def register_views(self, names: Iterable[str] = VIEWS, count: bool = False) -> DataFrame:
        """Temp views of the tables that are there. A report: name, status (ok, missing or the error), bytes, rows."""
        out = []
        for name in names:
            try:
                path = self.path(name)
                df = self.spark.read.parquet(path)
                df.createOrReplaceTempView(name)
                out.append((name, "ok", _file(self.spark, path), df.count() if count else None))
            except FileNotFoundError:
                out.append((name, "missing", None, None))
            except Exception as e:  # reported, as one bad file must not hide the others
                out.append((name, str(e).splitlines()[0][:200], None, None))
        return self.spark.createDataFrame(out, "name string, status string, bytes long, rows long")


def ids_relation(spark: SparkSession, ids: Iterable[int], name: str = "uid") -> DataFrame:
    """Given ids as a relation to join with, where an IN list would be spliced into text."""
    return spark.createDataFrame([(int(i),) for i in ids], f"{name} long")


# Adapters: the relations above from the generated test tables.


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    # divided before the start is taken off: div cuts towards zero, which is another tick before 2024
    ticks = F.expr("unix_seconds(cast(ts as timestamp)) div 5 - 1704067200 div 5")
    item = F.regexp_extract("props", '"k": *([0-9]+)', 1).try_cast("long")  # the first whole number after a k at any depth; null without one
    return e.select(F.col("user_id").alias("uid"), item.alias("item_id"), ticks.alias("timestamp"), F.col("event_type"), F.col("value").alias("played_ratio_pct"))


def listens_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listens from events: 5-second ticks from 2024-01-01; views and clicks are organic."""
    e = _event_rows(spark, sf_dir)
    return e.select("uid", "item_id", "timestamp", F.col("event_type").isin("view", "click").cast("short").alias("is_organic"), "played_ratio_pct")


def listens_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listens from order lines: a tick is 5 seconds from 1995-01-01, at the order's day."""
    li, o, p = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.col("o_custkey").alias("uid"),
            F.col("l_partkey").alias("item_id"),
            (F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long") * 17280).alias("timestamp"),
            (F.col("l_returnflag") != "R").cast("short").alias("is_organic"),
            (F.col("l_quantity") * 2).alias("played_ratio_pct"),
            F.col("p_size").alias("track_length_seconds"),
        )
    )


def likes_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_rows(spark, sf_dir).where("event_type in ('purchase', 'click')").select("uid", "item_id")


def multi_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_rows(spark, sf_dir).select("uid", "item_id", F.when(F.col("event_type") == "error", "unlike").otherwise(F.col("event_type")).alias("event_type"))


def artist_map_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of events to artists of ten items each."""
    return _event_rows(spark, sf_dir).select("item_id", F.expr("item_id div 10").alias("artist_id")).distinct()


def artist_map_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to their brand's number."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long").alias("artist_id"))


def album_map_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to albums by type and size."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size").cast("long") * 100 + F.length("p_type")).alias("album_id"))


def embeddings_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("normalized_embed"), F.col("label").cast("long").alias("community"))
