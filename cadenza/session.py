"""Spark sessions. Cluster settings come from the cluster; these only fill in what analyses rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "cadenza", cores: int | None = None, memory: str | None = None, spill_dir: str | None = None, **conf: str) -> SparkSession:
    """The current session or a new one with adaptive execution and UTC; ``conf`` keys have _ for .

    ``cores`` (a master of its own, on this machine), ``memory`` (such as "6g") and ``spill_dir`` hold for a new session only.
    """
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    given = {"spark.master": cores and f"local[{cores}]", "spark.driver.memory": memory, "spark.local.dir": spill_dir}
    own = {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    for k, v in {**fixed, **{k: v for k, v in given.items() if v}, **own}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
