"""Line dedup by site-relative frequency: lines that more than a share of a host's pages carry are boilerplate.

DataFrame functions only. A line counts once a page. Counting keys are the host and 128 bits of hash of the line, summed
before the shuffle, so a hot host or a hot line arrives as one row a task. Per host at most (distinct lines a page) / ratio
lines can exceed the ratio. Their list is broadcast to the pages while common.SMALL_BYTES hold it, so that no text is shuffled;
beyond it the pages meet their host's list in a join, each host's pages dealt to SALT parts and its list sent to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import fits, saved

SALT = 64


def host_of(url: Column | str) -> Column:
    """The lower-case host of a URL, without user and port; null where there is none."""
    host = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5, names: tuple[str, str, str] = ("n_lines", "n_dropped", "all_common")) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and new columns n_lines, n_dropped (long), all_common (boolean).

    A line (split at \\n) goes when more than ``ratio`` of its host's pages, and at least ``min_pages``, have it. ``host`` is a
    column, or an expression such as host_of("url"). Blank lines (nothing but spaces) stay and don't count. A page of nothing but
    boilerplate keeps its text, so that no page ends empty for it, and is told by all_common. Null hosts form a host of their own; null texts
    stay null with no lines (0, 0, false), empty ones have one blank line. Repeated rows are pages like any other; an empty table gives an
    empty one. Columns of the new names are replaced (``names`` gives others), all others stay, whatever they are called.
    """
    site = F.col(host) if isinstance(host, str) else host
    rest = [c for c in docs.columns if c not in names or c == text]
    # the row is kept in one piece, so its columns can't clash with those made here
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.coalesce(F.concat(F.lit("="), site.cast("string")), F.lit("-")).alias("site"), F.col(f"`{text}`").cast("string").alias("t"))
    lines = F.split("t", "\n", -1)
    full = lambda a: F.filter(a, lambda x: F.trim(x) != "")
    seen = base.where("t is not null").select("site", F.explode(F.array_distinct(full(lines))).alias("line"))
    pages = seen.select("site", _key(F.col("line")).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = base.groupBy("site").agg(F.count("*").alias("total"))
    common = pages.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("total"))
    common = saved(common.groupBy("site").agg(F.collect_list("key").alias("common")), "common")
    if fits(common, F.size("common") * 64 + 64):
        met = base.join(F.broadcast(common), "site", "left")
    else:
        part = F.pmod(F.xxhash64("t"), F.lit(SALT)).cast("int")
        each = common.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = base.withColumn("part", part).join(each, ["site", "part"], "left")

    kept = F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("common"), _key(x)))
    out = met.select("row", "t", lines.alias("lines"), "common").withColumn("kept", F.when(F.col("common").isNotNull(), kept))
    less = F.size("kept") < F.size("lines")
    left = F.exists("kept", lambda x: F.trim(x) != "")
    cut = F.coalesce(less & left, F.lit(False))
    cells = [F.when(cut, F.array_join("kept", "\n")).otherwise(F.col(f"row.`{c}`").cast("string")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in rest]
    return out.select(
        *cells,
        F.when(F.col("t").isNull(), 0).otherwise(F.size("lines")).cast("long").alias(names[0]),
        F.when(cut, F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias(names[1]),
        F.coalesce(less & ~left, F.lit(False)).alias(names[2]),
    )


def oracle(docs: str = "documents", ratio: float = 0.1, min_pages: int = 5, columns: str = "doc_id, text, n_lines, n_dropped, all_common") -> str:
    """DuckDB SQL of the same rows; doc_id must tell rows apart."""
    return f"""
WITH d AS (SELECT *, coalesce('=' || source, '-') AS site, string_split(text, chr(10)) AS ls FROM {docs}),
one AS (SELECT site, doc_id, unnest(list_distinct(ls)) AS line FROM d WHERE text IS NOT NULL),
pages AS (SELECT site, line, count(*) AS n FROM one WHERE trim(line, ' ') <> '' GROUP BY site, line),
totals AS (SELECT site, count(*) AS total FROM d GROUP BY site),
common AS (SELECT site, list(line) AS bad FROM pages JOIN totals USING (site) WHERE n >= {min_pages} AND n > {ratio} * total GROUP BY site),
k AS (SELECT d.*, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(bad, x)) END AS kept FROM d LEFT JOIN common USING (site)),
c AS (SELECT *, len(list_filter(kept, lambda x: trim(x, ' ') <> '')) > 0 AS stays, len(kept) < len(ls) AS less FROM k),
r AS (SELECT *, less AND stays AS cut FROM c),
t AS (SELECT * REPLACE (CASE WHEN cut THEN array_to_string(kept, chr(10)) ELSE text END AS text), CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(CASE WHEN cut THEN len(ls) - len(kept) ELSE 0 END AS BIGINT) AS n_dropped, coalesce(less AND NOT stays, false) AS all_common FROM r)
SELECT {columns} FROM t
"""
