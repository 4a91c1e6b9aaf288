"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

DataFrame functions only.

A window is as many words as an item has (a shorter text is one window), at every place of a text. Windows that can't reach the
similarity are not fingerprinted: texts' shingle hashes are matched with the items' first (a hash join; the items' side is broadcast
while common.SMALL_BYTES hold it, and shuffled beyond it), each match says which windows hold it, and what a window holds of all
items together must weigh ``least`` times the lightest item of its length, or no item can be that similar. All others
and the items get a SimHash of 64 bits over their weighted shingles. Fingerprints are cut into radius + 1 blocks,
and two fingerprints within ``radius`` bits agree in at least one block, so joining on blocks finds all of them; the
distance is then counted exactly, and candidates' weighted Jaccard similarity computed on their full shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import fits, saved

#: Bits in which two fingerprints of similarity 0.75 may differ: about 11 with a deviation of 3.
RADIUS = 24


def words(text: Column) -> Column:
    """Words of A-Z lower-cased text: runs of anything but ASCII white space."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(low, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, wherever f uses it."""
    return F.transform(F.array(value), f)[0]


def shingles(w: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words in order; of fewer words the whole as one."""
    return let(w, lambda w: _shingles(w, width))


def _shingles(w: Column, width: int) -> Column:
    n = F.size(w)
    full = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    short = F.array(F.xxhash64(F.array_join(w, " "), n))
    return F.when(n >= width, full).when(n > 0, short).otherwise(F.array().cast("array<long>"))


def _grams(w: Column, k: int, width: int) -> Column:
    """What shingles() gives for each window of ``k`` words, k at most ``width``."""
    one = (lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])) if k == width else (lambda w, i: F.xxhash64(F.array_join(F.slice(w, i + 1, k), " "), F.lit(k)))
    return let(w, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: one(w, i))))


def fingerprint(s: Column, weights: Column, default: Column) -> Column:
    """SimHash of shingles ``s``; each weighs what the map ``weights`` says, others ``default``. Each occurrence counts."""
    pairs = F.transform(s, lambda h: F.struct(h.alias("h"), F.coalesce(F.element_at(weights, h), default).alias("w")))
    return let(pairs, _bits)


def _bits(pairs: Column) -> Column:
    bit = lambda b: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(F.getbit(p["h"], b) == 1, p["w"]).otherwise(-p["w"]))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(bit(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _items(bench: DataFrame, width: int) -> DataFrame:
    """item_id, n (words), s (shingles) of items with words."""
    w = bench.select("item_id", words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    return w.select("item_id", F.size("w").alias("n"), shingles(F.col("w"), width).alias("s")).dropDuplicates(["item_id", "n", "s"])


def _key(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text; such as are equal in both have equal results."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), words(F.col("text").cast("string")).alias("w"))


def matches(docs: DataFrame, bench: DataFrame, width: int = 5, least: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, item_id, start, similarity, n_windows: items that a window of the document repeats.

    ``docs``: doc_id, text; ``bench``: item_id, text. Similarity is the weighted Jaccard of distinct shingles; a shingle weighs
    1 + ln((1 + items) / (1 + items with it)). A row for each document and item with a window of at least ``least``:
    its first best window's first word, its similarity, and how many windows reach it. Null and empty texts and items match
    nothing, nor do items without an id; repeated items match alike; repeated rows give one row for each item. Empty tables give an empty result; other columns
    are left out.
    """
    items = saved(_items(bench, width), "items")
    each = items.select("item_id", "n", F.xxhash64("s").alias("of"), F.explode(F.array_distinct("s")).alias("h"))
    total = items.count()
    default = F.lit(1.0) + F.log(F.lit(1.0 + total))
    df = each.groupBy("h").agg(F.count_distinct("item_id").alias("df"))
    weighed = saved(each.join(df.select("h", (1 + F.log(F.lit(1.0 + total) / (1 + F.col("df")))).alias("weight")), "h"), "weighed")
    mass = weighed.groupBy("item_id", "n", "of").agg(F.sum("weight").alias("mass")).groupBy("n").agg((F.min("mass") * least - 1e-6).alias("needed"))
    known = weighed.join(mass, "n").groupBy("h", "weight").agg(F.collect_set(F.struct("n", "needed")).alias("sizes"))
    known = saved(known, "known")
    sizes = sorted(r.n for r in items.select(F.least("n", F.lit(width)).alias("n")).distinct().collect())  # at most ``width`` numbers
    known_small = fits(known, 64 + 32 * F.size("sizes"))

    base = _key(docs)
    hits = None
    for k in sizes:  # items shorter than a shingle are one shingle of their own length
        found = base.select("doc_id", "key", F.size("w").alias("nw"), F.posexplode(_grams(F.col("w"), k, width)).alias("p", "h"))
        found = found.join(F.broadcast(known) if known_small else known, "h").withColumn("g", F.lit(k))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = base.select("doc_id", "key", F.size("w").alias("nw"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("h")).crossJoin(known.drop("h")).withColumn("g", F.lit(0)).where("false")
    hits = saved(hits, "hits")
    weights = hits.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("h", "weight"))).alias("weights"))
    # the windows of n words that hold a match begin from lo to hi, in one run of n beginnings or in two
    hits = hits.select("doc_id", "key", "nw", "p", "h", "g", "weight", F.explode("sizes").alias("z")).where(F.col("g") == F.least("z.n", F.lit(width))).select("*", "z.n", "z.needed")
    last = F.greatest(F.lit(0), F.col("nw") - F.col("n"))
    hits = hits.withColumn("lo", F.greatest(F.lit(0), F.col("p") - F.col("n") + F.col("g"))).withColumn("hi", F.least(F.col("p"), last))
    run = lambda c: F.floor(F.col(c) / F.col("n")).cast("int")
    hits = hits.withColumn("run", F.explode(F.sequence(run("lo"), run("hi"))))
    near = hits.groupBy("doc_id", "key", "nw", "n", "needed", "run").agg(F.collect_set(F.struct("lo", "hi", "h", "weight")).alias("found"))
    starts = F.sequence(F.col("run") * F.col("n"), F.least(F.col("run") * F.col("n") + F.col("n") - 1, last))
    held = lambda s: F.aggregate("found", F.lit(0.0), lambda a, x: a + F.when((x["lo"] <= s) & (s <= x["hi"]), x["weight"]).otherwise(0.0))
    near = near.select("doc_id", "key", "n", F.filter(starts, lambda s: held(s) >= F.col("needed")).alias("starts")).where(F.size("starts") > 0)
    near = near.groupBy("doc_id", "key").agg(F.collect_list(F.struct("n", "starts")).alias("at")).alias("n")
    near = saved(near.join(weights.alias("w"), F.expr("n.key = w.key and n.doc_id <=> w.doc_id")).select("n.doc_id", "n.key", "n.at", "w.weights"), "windows")
    near_small = fits(near, 64 + 16 * F.size("weights") + F.aggregate("at", F.lit(0), lambda a, x: a + 64 + 4 * F.size(x["starts"])))

    texts = base.alias("t").join((F.broadcast(near) if near_small else near).alias("n"), F.expr("t.key = n.key and t.doc_id <=> n.doc_id")).select("t.doc_id", "t.key", "t.w", "n.weights", F.explode("n.at").alias("at"))
    texts = texts.select("doc_id", "key", "w", "weights", F.col("at.n").alias("n"), F.explode("at.starts").alias("start"))
    texts = texts.select("doc_id", "key", "n", "start", "weights", shingles(F.slice("w", F.col("start") + 1, F.col("n")), width).alias("s")).dropDuplicates(["doc_id", "key", "start", "n"])
    prints = saved(texts.withColumn("f", fingerprint(F.col("s"), F.col("weights"), default)), "fingerprints")

    masks = _masks(radius + 1)
    blocks = F.array(*[F.lit(m) for m in masks])
    split = lambda d: d.select("*", F.posexplode(F.transform(blocks, lambda m: F.col("f").bitwiseAND(m))).alias("block", "value"))
    own = weighed.groupBy("item_id", "n").agg(F.map_from_entries(F.collect_set(F.struct("h", "weight"))).alias("own"))
    coded = saved(items.join(own, ["item_id", "n"]).select("item_id", "n", F.col("s").alias("t"), "own", fingerprint(F.col("s"), F.col("own"), default).alias("f")), "coded")
    # copies have equal fingerprints: blocks are joined once for each of these, and carry nothing else
    one, two = split(prints.select("n", "f").distinct()).alias("a"), split(coded.select("item_id", "n", "f")).alias("b")
    differ = F.col("a.f").bitwiseXOR(F.col("b.f"))
    # of the blocks in which two agree, the first makes the pair
    first = F.array_position(F.transform(blocks, lambda m: differ.bitwiseAND(m) == 0), F.lit(True)) == F.col("a.block") + 1
    pairs = one.join(two, (F.col("a.n") == F.col("b.n")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & (F.bit_count(differ) <= radius) & first)
    pairs = saved(pairs.select("a.n", "a.f", "b.item_id").distinct(), "pairs")
    near_items = pairs.join(coded.select("item_id", "n", "t", "own").dropDuplicates(["item_id", "n", "t"]), ["item_id", "n"])
    weight = lambda h: F.coalesce(F.element_at("weights", h), F.element_at("own", h), default)
    total_of = lambda x: F.aggregate(x, F.lit(0.0), lambda s, h: s + weight(h))
    exact = total_of(F.array_intersect("s", "t")) / total_of(F.array_union("s", "t"))
    close = prints.join(near_items, ["n", "f"]).select("doc_id", "key", "item_id", "start", exact.alias("similarity")).where(F.col("similarity") >= least)
    best = F.max(F.struct(F.col("similarity"), -F.col("start")))
    return close.groupBy("doc_id", "key", "item_id").agg(best.alias("best"), F.count_distinct("start").alias("n_windows")).select("doc_id", "key", "item_id", (-F.col("best.col2")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"), "n_windows")


def _masks(n: int) -> list[int]:
    """64 bits in ``n`` blocks, as signed integers."""
    edges = [64 * i // n for i in range(n + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def decontaminate(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that repeat an item. All columns stay, whatever they are called, null ids and texts included; empty tables drop nothing."""
    bad = saved(matches(docs.select("doc_id", "text"), bench, **how).select("doc_id", "key").distinct(), "contaminated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key")).alias("d")
    bad = (F.broadcast(bad) if fits(bad, 64) else bad).alias("b")
    return keyed.join(bad, F.expr("d.key = b.key and d.row.doc_id <=> b.doc_id"), "left_anti").select("row.*")
