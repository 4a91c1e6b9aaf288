"""Runs analyses by id; one that fails is reported and the others go on."""

from __future__ import annotations

import resource
import time
import traceback
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: The analyses and the queries they consist of.
TASKS: dict[int, tuple[str, tuple[str, ...]]] = {
    1: ("monthly", ("monthly_activity", "monthly_quality", "growth_summary", "top_artists_by_flag")),
    2: ("sessions", ("sessions", "session_summary_by_flag", "session_long_vs_short", "session_verdict")),
    3: ("colikes", ("net_like_stats", "colike_edges_item", "colike_edges_artist", "induced_topn_edges", "communities", "adjacency_cells")),
    4: ("diversity", ("entropy_item", "entropy_artist", "entropy_quartile_medians", "diversity_verdict")),
    5: ("heatmap", ("heatmap_week_normalised", "heatmap_lifecycle_grid", "attention_night_vs_day")),
    6: ("colisten", ("colisten_edges_item", "colisten_edges_artist", "colisten_warnings", "embedding_separation")),
    7: ("churn", ("churn_features", "churn_feature_correlation", "churn_model_metrics", "churn_importances")),
}


def memory(spark: SparkSession) -> tuple[float, float]:
    """MB in use: the largest resident size of the driver's Python so far, and its JVM's heap now."""
    jvm = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1), round((jvm.totalMemory() - jvm.freeMemory()) / 1e6, 1)


def run(spark: SparkSession, sf_dir: str, tasks: Iterable[int] | None = None, sink: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """task, name, status (ok, unknown or the error), seconds, rss_mb (the driver's Python) and heap_mb (its JVM) after the task, with what it kept let go.

    ``sink`` gets every result; without one they are only computed.
    """
    from cadenza.plans.queries import QUERIES

    out = []
    for k in TASKS if tasks is None else tasks:
        if k not in TASKS:
            out.append((int(k), None, "unknown", 0.0, None, None))
            continue
        name, parts = TASKS[k]
        began, status = time.monotonic(), "ok"
        try:
            for part in parts:
                df = QUERIES[part](spark, sf_dir)
                sink(part, df) if sink else df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # one analysis must not end the others; the report tells
            status = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]
            traceback.print_exc()
        spark.catalog.clearCache()
        out.append((k, name, status, round(time.monotonic() - began, 3), *memory(spark)))
    return spark.createDataFrame(out, "task int, name string, status string, seconds double, rss_mb double, heap_mb double")
