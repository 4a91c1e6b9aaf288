"""Column helpers: buckets, guarded ratios, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.config import DEFAULT, Settings


def seconds(ticks: Column | str = "timestamp", settings: Settings = DEFAULT) -> Column:
    """Absolute seconds of absolute ticks; never cumulated."""
    return (F.col(ticks) if isinstance(ticks, str) else ticks).cast("long") * settings.tick_seconds


def floor_bucket(x: Column, width: int) -> Column:
    """Whole buckets since 0."""
    return F.floor(x / width).cast("int")


def round_bucket(x: Column, width: int) -> Column:
    """The nearest bucket, halves to the even one: how a float division cast to an integer rounds in the source's SQL."""
    return F.rint(x / width).cast("int")


def bucket(x: Column, width: int, mode: str = "round") -> Column:
    return {"round": round_bucket, "floor": floor_bucket}[mode](x, width)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole * 100)


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / whole, by 1 where whole is not positive."""
    return part.cast("double") / F.when(whole > 0, whole).otherwise(1)


def uid_bucket(uid: Column | str, buckets: int) -> Column:
    """Bucket of ids that are multiples of 10."""
    u = F.col(uid) if isinstance(uid, str) else uid
    return F.floor(u / 10).cast("long") % buckets


def labelled(label: Column | str, id_: Column | str) -> Column:
    """A label, or # and the id where there is none."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(c(label), F.concat(F.lit("#"), c(id_).cast("string")))
