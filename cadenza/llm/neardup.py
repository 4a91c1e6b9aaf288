"""MinHash near-dedup with tensored banding.

Two collections of ``tables`` bands, of ``rows`` minima a band, give tables * tables keys by pairing every band of the one
with every band of the other: 2 * tables * rows minima do the work of 2 * tables**2 * rows. At a Jaccard similarity s a
pair shares a key with probability (1 - (1 - s**rows)**tables)**2; with 14 and 2, 0.99998 at 0.75 and more
above. Only the bands of the first collection are shuffled (``tables`` rows a text, each with all bands of the second);
the pairs are formed where rows with equal first bands meet. Rows of a first band that HOT classes share are dealt out once more, by each of their second bands.

Texts of equal shingle sets are one class, seen once. Documents of a bucket are not paired with each other all at once:

1. Each is a candidate with its bucket's smallest id, if sizes and a sketch of 40 four-bit minima allow; it is checked
   against the smallest such id over all its buckets, and checked links join into components.
2. In buckets that still hold several components, the pairs between different components that sizes and sketches allow
   are summed up by a spanning forest; what these forests connect is a neighbourhood. The documents of a neighbourhood meet in
   pairs of blocks, where all pairs between different components are checked, again giving a forest of links.

Every check takes the full sets. A hot partner is dealt out: its text goes to one task for about 256 documents compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import shingles
from cadenza.llm.common import components, cut, fits, saved, tidy

SKETCH = 40
#: Sketches of pairs at a similarity of 0.75 agree in 30.6 of 40 places, with a deviation of 2.7; fewer than 18 never.
AGREE = 18
#: Rows that may be broadcast (24 bytes each).
SMALL = 1_000_000
MEMBERS = 256
#: Classes with one first band from which their rows are dealt out by the second bands as well.
HOT = 20_000
ROW = "id long, n long, bands binary, sketch binary"


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    try:
        for b in batches:
            for at in range(0, b.num_rows, n):
                yield b.slice(at, n)
    finally:
        tidy()


def signatures(docs: DataFrame, width: int = 5, k: int = 40) -> DataFrame:
    """doc_id, n (set size), set_id, sig (k minima of 32 bits; null without shingles) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 256):
            sets = [shingles.shingle_set(w, width) for w in shingles.word_hashes(b.column("text").to_pylist())]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            for i, m in zip(full, shingles.min_hashes([sets[i] for i in full], k), strict=True):
                sig[i] = m.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([shingles.set_id(s) for s in sets], pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "set_id", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, set_id binary, sig binary")


def _keys(reps: DataFrame, tables: int, rows: int) -> DataFrame:
    """key (a band of the first collection), id, n, bands (all of the second), sketch: ``tables`` rows for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.random.default_rng(11).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        for b in _batches(batches, 1000):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            bands = shingles.mix((sig.reshape(b.num_rows, 2, tables, rows).astype(np.uint64) * turn).sum(axis=3, dtype=np.uint64))
            keys = shingles.mix(bands[:, 0] + np.arange(tables, dtype=np.uint64)).reshape(-1).view(np.int64)
            second = pa.array([r.tobytes() for r in (bands[:, 1] >> np.uint64(32)).astype(np.uint32)], pa.binary())
            low = (sig[:, :SKETCH] & np.uint32(15)).astype(np.uint8)
            sketch = pa.array([r.tobytes() for r in low[:, 0::2] | (low[:, 1::2] << 4)], pa.binary())
            each = pa.array(np.repeat(np.arange(b.num_rows), tables))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(each) for c in (b.column("id"), b.column("n"), second, sketch))], names=["key", "id", "n", "bands", "sketch"])

    return reps.select("id", "n", "sig").mapInArrow(run, f"key long, {ROW}")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups (rows with equal keys, which follow each other), several groups in each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys)
        at = np.flatnonzero(change)
        if len(at):
            held.append(b.slice(0, at[-1]))
            if t := [x for x in held if x.num_rows]:
                yield pa.Table.from_batches(t)
            held = [b.slice(at[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
    held = []
    tidy()


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    out = np.empty((len(raw), raw.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = raw & 15, raw >> 4
    return out


def _bands(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _tables(key: np.ndarray, bands: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band of the second collection: rows ordered by key and band, and the places where a bucket begins."""
    for j in range(bands.shape[1]):
        order = np.lexsort((bands[:, j], key))
        k, v = key[order], bands[order, j]
        yield order, np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]))))


def _split(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``keyed`` whose first band less than HOT classes have, and those of hot ones, each dealt to a key for each of its second bands, with that band only."""
    hot = saved(keyed.groupBy("key").count().where(f"count >= {HOT}").select("key"), "hot")  # at most rows / HOT
    if hot.isEmpty():
        return keyed, None
    hot = F.broadcast(hot) if fits(hot, 32) else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 1000):
            bands = _bands(b.column("bands"))
            each = np.repeat(np.arange(b.num_rows), bands.shape[1])
            turn = np.tile(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), b.num_rows)
            key = shingles.mix(b.column("key").to_numpy().view(np.uint64)[each] + shingles.mix((bands.reshape(-1).astype(np.uint64) << np.uint64(8)) | turn))
            own = pa.array([x.tobytes() for x in bands.reshape(-1)], pa.binary())
            each = pa.array(each)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(b.column(c).take(each) for c in ("id", "n")), own, b.column("sketch").take(each)], names=["key", "id", "n", "bands", "sketch"])

    return keyed.join(hot, "key", "left_anti"), keyed.join(hot, "key", "left_semi").select("key", "id", "n", "bands", "sketch").mapInArrow(run, f"key long, {ROW}")


def _buckets(keyed: DataFrame, percent: int) -> DataFrame:
    """The rows that share a bucket with another: key, id, n, bands, sketch, low (smallest id it is a candidate with)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key"]):
            key = t.column("key").to_numpy()
            own = np.concatenate(([True], key[1:] != key[:-1]))
            alone = own & np.concatenate((own[1:], [True]))
            if alone.all():
                continue
            t = t.filter(pa.array(~alone))
            key, n, ids = (t.column(c).to_numpy() for c in ("key", "n", "id"))
            sk = _sketches(t.column("sketch"))
            low, shared = np.full(len(key), np.iinfo(np.int64).max), np.zeros(len(key), bool)
            for order, first in _tables(key, _bands(t.column("bands"))):
                size = np.diff(np.append(first, len(order)))
                lead = order[np.repeat(first, size)]  # rows come by id, so the first has the smallest
                pick = np.repeat(size > 1, size)
                row, lead = order[pick], lead[pick]
                shared[row] = True
                ok = (row != lead) & (ids[row] != ids[lead]) & ((sk[row] == sk[lead]).sum(axis=1) >= AGREE) & (100 * np.minimum(n[row], n[lead]) >= percent * np.maximum(n[row], n[lead]))
                low[row[ok]] = np.minimum(low[row[ok]], ids[lead[ok]])
            t = t.append_column("low", pa.array(low, mask=low == np.iinfo(np.int64).max)).filter(pa.array(shared))
            yield from t.combine_chunks().to_batches(max_chunksize=20_000)

    rows = keyed.repartition("key").sortWithinPartitions("key", "id")
    return rows.mapInArrow(run, f"key long, {ROW}, low long")


def _forest(top: dict[int, int], a: int, b: int) -> bool:
    """Join two nodes; whether they were apart."""
    for x in (a, b):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        a, b = b, x
    if a == b:
        return False
    top[max(a, b)] = min(a, b)
    return True


def _between(buckets: DataFrame, percent: int) -> DataFrame:
    """a, b: for each group of buckets, a spanning forest of the pairs in different components that sizes and sketches allow.

    Rows of a key must follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key"]):
            key, comp = t.column("key").to_numpy(), t.column("comp").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            mixed = np.minimum.reduceat(comp, edge) != np.maximum.reduceat(comp, edge)
            if not mixed.any():
                continue
            t = t.filter(pa.array(np.repeat(mixed, np.diff(np.append(edge, len(key))))))
            key, comp, ids, n = (t.column(c).to_numpy() for c in ("key", "comp", "id", "n"))
            sk, top, a, b = _sketches(t.column("sketch")), {}, [], []
            for order, first in _tables(key, _bands(t.column("bands"))):
                for i, j in zip(first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True):
                    if j - i < 2:
                        continue
                    row = order[i:j]
                    if (comp[row] == comp[row[0]]).all():
                        continue
                    for x in range(0, len(row), 256):
                        u = row[x : x + 256]
                        ok = (comp[u][:, None] != comp[row][None]) & (100 * np.minimum(n[u][:, None], n[row][None]) >= percent * np.maximum(n[u][:, None], n[row][None]))
                        p, q = np.nonzero(ok)
                        p, q = p[q > p + x], q[q > p + x]
                        for s in range(0, len(p), 100_000):
                            y, z = u[p[s : s + 100_000]], row[q[s : s + 100_000]]
                            like = (sk[y] == sk[z]).sum(axis=1) >= AGREE
                            for c, d in zip(ids[y[like]].tolist(), ids[z[like]].tolist(), strict=True):
                                if _forest(top, c, d):
                                    a.append(c)
                                    b.append(d)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def _packed(docs: DataFrame, need: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """``columns`` of ``need`` (doc_id, ...) and the compressed text as ``packed``; a small ``need`` is broadcast to the texts."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in _batches(batches, 512):
            packed = pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), packed], names=[*columns, "packed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(need) if small else need, "doc_id").select(*columns, "text")
    return found.mapInArrow(squeeze, ", ".join(f"{c} long" for c in columns) + ", packed binary")


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    z = zstandard.ZstdDecompressor()
    texts = [z.decompress(x).decode("utf-8", "surrogatepass") for x in batch.column("packed").to_pylist()]
    return [shingles.shingle_set(w, width) for w in shingles.word_hashes(texts)]


def check(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    A partner ``a`` with many pairs is dealt out to parts of about 256 of them, its text once to each. The pairs are
    broadcast to the texts if they are at most SMALL, and joined by a shuffle beyond it.
    """
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")).where("parts > 1")
    dealt = cut(pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("long").alias("part")))
    need = dealt.select(F.col("b").alias("doc_id"), "a", "part", F.col("b").alias("other")).union(dealt.select("a", "part").distinct().select(F.col("a"), "a", "part", F.lit(None).cast("long")))
    packed = _packed(docs, need, ["a", "part", "other"], dealt.count() <= SMALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in _batches(batches, 128):
            a, b = [], []
            for key, part, other, s in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("other").to_pylist(), _sets(batch, width), strict=True):
                if other is None:
                    at, own = (key, part), s
                elif at == (key, part) and len(own) and len(s):
                    both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(key)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = packed.repartition("a", "part").sortWithinPartitions("a", "part", F.col("other").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long").distinct()


def check_blocks(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components of a neighbourhood: all such pairs are checked, a forest of the links is given.

    ``members``: hood, id, comp. Neighbourhoods are dealt to blocks of about 256 documents, every two blocks meet in one task.
    """
    # a large component of a neighbourhood has blocks of its own, which need not meet each other
    parts = members.groupBy("hood", "comp").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("hood").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("main")).where("all > main.n")
    main = F.when(F.col("main.n") >= MEMBERS, F.col("main.n")).otherwise(0)
    sizes = sizes.select("hood", F.when(main > 0, F.col("main.comp")).alias("main"), F.ceil(main / MEMBERS).cast("int").alias("mb"), F.ceil((F.col("all") - main) / MEMBERS).cast("int").alias("ob"))
    inner = F.col("comp").eqNullSafe(F.col("main"))
    turn = F.xxhash64("id")
    own = F.when(inner, F.pmod(turn, F.greatest("mb", F.lit(1)))).otherwise(F.col("mb") + F.pmod(turn, F.col("ob"))).cast("long")
    dealt = cut(members.join(sizes, "hood").select("hood", "id", "comp", own.alias("own"), F.when(inner, F.col("mb")).otherwise(0).alias("low"), (F.col("mb") + F.col("ob") - 1).alias("high")))
    need = dealt.withColumn("other", F.explode(F.sequence("low", "high")))
    need = need.withColumn("other", F.col("other").cast("long"))
    need = need.select(F.col("id").alias("doc_id"), "hood", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "comp")
    packed = _packed(docs, need, ["hood", "p", "q", "own", "id", "comp"], need.count() <= SMALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        at, top = None, {}

        def compare() -> tuple[list[int], list[int]]:
            a, b = [], []
            if len(held) < 2 or len({x[2] for x in held}) < 2:
                return a, b
            p, q = at[1], at[2]
            there = [x for x in held if x[0] == q]
            flat = np.concatenate([x[3] for x in there] or [np.empty(0, np.uint64)])
            who = np.repeat(np.arange(len(there)), [len(x[3]) for x in there])
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            sizes = np.array([len(x[3]) for x in there])
            comps = np.array([x[2] for x in there])
            ids = np.array([x[1] for x in there])
            for _, i, comp, s in (x for x in held if x[0] == p):
                if (comps == comp).all():
                    continue
                lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
                n = hi - lo
                total = int(n.sum())
                if not total:
                    continue
                at_ = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                both = np.bincount(who[at_], minlength=len(there))
                for j in np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (comps != comp)).tolist():
                    if _forest(top, comp, int(comps[j])):
                        a.append(i)
                        b.append(int(ids[j]))
            return a, b

        for batch in _batches(batches, 128):
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("hood", "p", "q", "own", "id", "comp")]
            for hood, p, q, own, i, comp, s in zip(*columns, _sets(batch, width), strict=True):
                if (hood, p, q) != at:
                    if at:
                        x, y = compare()
                        a, b = a + x, b + y
                    held, at, top = [], (hood, p, q), {}
                held.append((own, i, comp, s))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if at:
            a, b = compare()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = packed.repartition("hood", "p", "q").sortWithinPartitions("hood", "p", "q", "id")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, tables: int = 14, rows: int = 2) -> DataFrame:
    """A row per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id, kept.

    Null texts, empty ones and such without words have no shingles, link with nothing and stay. Repeated doc_ids are one document
    each in the links; rows without doc_id link with nothing (component_id null, kept true). Ties go to the smallest
    doc_id. An empty table gives an empty result. Other columns are left out.
    """
    sigs = cut(signatures(docs, width, 2 * tables * rows))
    classes = cut(sigs.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    plain, hot = _split(_keys(classes, tables, rows))
    parts = [cut(_buckets(x, percent)) for x in (plain, hot) if x is not None]
    sources = docs.select("doc_id", "text")
    low = [x.where("low is not null").select("id", "low") for x in parts]
    first = reduce(DataFrame.union, low).groupBy("id").agg(F.min("low").alias("a")).select("a", F.col("id").alias("b"))
    links = cut(check(first, sources, width, percent))
    comp = cut(components(links))
    small = fits(comp, 64)
    by_id = comp.withColumnRenamed("node", "id")

    def told(buckets: DataFrame) -> DataFrame:
        # buckets stay in their partitions and order if the components come by broadcast
        x = buckets.drop("low").join(F.broadcast(by_id) if small else by_id, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")
        x = x if small else x.repartition("key").sortWithinPartitions("key", "id")
        return _between(x.select("key", "id", "n", "bands", "sketch", "comp"), percent)

    near = cut(reduce(DataFrame.union, map(told, parts)))
    if near.isEmpty():
        final = comp.withColumnRenamed("node", "id")
    else:
        ends = near.select(F.col("a").alias("id")).union(near.select("b")).distinct().join(by_id, "id", "left").select("id", F.coalesce("component_id", "id").alias("comp"))
        # documents of a component that touches a neighbourhood belong to it with all that is linked to them
        hoods = cut(components(near.union(ends.select("id", "comp")))).withColumnRenamed("component_id", "hood")
        inside = comp.join(hoods.withColumnRenamed("node", "component_id"), "component_id").select("hood", F.col("node").alias("id"), F.col("component_id").alias("comp"))
        inside = cut(inside.union(ends.join(hoods.withColumnRenamed("node", "id"), "id").select("hood", "id", "comp")).distinct())
        final = components(links.union(check_blocks(inside, sources, width, percent))).withColumnRenamed("node", "id")
    by_set = classes.select("set_id", "id").join(final, "id", "left").select("set_id", F.coalesce("component_id", "id").alias("component_id"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
