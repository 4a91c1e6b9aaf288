"""Embedding near-dedup by NN-descent: a neighbour graph, refined through neighbours of neighbours.

1. Equal vectors are one class. Null, zero and non-finite vectors link with nothing.
2. The graph begins with the nearest of those with equal signs under random hyperplanes, over several draws. Buckets are
   cut to runs of at most ``BLOCK`` vectors, ordered by further signs.
3. Descent: every vector gathers its neighbours and those that have it as neighbour, and compares them with each other;
   pairs that improve a list replace its last entries. Rounds go on until few entries change, or none that is a link; the audit
   then tells whether that was enough.
4. A list whose last entry still reaches the threshold is saturated: it may end before its links do. Blocks of such
   components that can be linked (by centre and radius) are compared, and linked components become one. Lists of the
   component such a vector is in are then enlarged to the whole component, whose vectors meet in pairs of blocks.
5. Audit of what is returned: for a fixed number of vectors chosen by hash, all links are found by comparison with all rows;
   if the enlarged lists have less than ``recall`` of them, descent goes on with lists of twice the length. Where
   ``doublings`` of them don't suffice, all vectors meet in pairs of blocks, which is exact and costs the square of their number.

Cosines are of double precision. Vectors travel as 32-bit floats, as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import components, cut, saved, slim
from cadenza.llm.neardup import _batches, _groups

BLOCK = 512
EDGE = "a long, b long, s double"


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def readable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v: the vector's bytes as doubles, null if it can't link.

    Vectors of different lengths can't be compared and don't link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 4096):
            out, dims = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                x = np.asarray(v, np.float64) if v and i is not None and None not in v else np.zeros(0)
                most = np.abs(x).max(initial=0)
                good = bool(len(x)) and np.isfinite(most) and most > 0
                # norms of the largest and smallest numbers would overflow
                out.append((x if 1e-100 < most < 1e100 else x / most).tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each of the vectors among the others: (own, other, cosine)."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[top.reshape(-1)], np.take_along_axis(s, top, axis=1).reshape(-1)


def _edges(a: list, b: list, s: list) -> pa.RecordBatch:
    join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
    return pa.RecordBatch.from_arrays([join(a, pa.int64()), join(b, pa.int64()), join(s, pa.float64())], names=["a", "b", "s"])


def first_graph(reps: DataFrame, n: int, k: int, draws: int, seed: int = 5) -> DataFrame:
    """a, b, s: nearest vectors under equal signs of random hyperplanes, ``draws`` times."""
    bits = max(1, int(np.ceil(np.log2(max(n, 2) / 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in _batches(batches, 2048):
            ids, dims, raw = b.column("id").to_numpy(), b.column("dim").to_numpy(), b.column("v").to_pylist()
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, draws * 48))
                sign = (x @ planes[d] > 0).reshape(len(own), draws, 48)
                code = sign @ (1 << np.arange(48)[::-1])  # the first signs in the highest bits
                v = pa.array([raw[i] for i in own], pa.binary())
                for t in range(draws):
                    bucket = ((code[:, t] >> (48 - bits)) * 64 + t) * 4096 + d % 4096
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(code[:, t]), pa.array(ids[own]), pa.array(dims[own]), v], names=["bucket", "code", "id", "dim", "v"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["bucket"]):
            bucket, ids, dims = (t.column(c).to_numpy() for c in ("bucket", "id", "dim"))
            edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (dims[1:] != dims[:-1]), [True])))
            a, b, s = [], [], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = _unit(t.column("v").slice(i, j - i))
                for at in range(0, j - i, BLOCK // 2):  # runs overlap by half
                    if at and j - i - at <= BLOCK // 2:
                        break
                    own = slice(at, at + BLOCK)
                    if len(x[own]) > 1:
                        for out, got in zip((a, b, s), _best(ids[i:j][own], x[own], k), strict=True):
                            out.append(got)
            yield _edges(a, b, s)

    rows = reps.mapInArrow(run, "bucket long, code long, id long, dim int, v binary")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "dim", "code", "id")
    return rows.mapInArrow(near, EDGE)


def shorten(edges: DataFrame, k: int) -> DataFrame:
    """The k best entries of each list: a, b, s, fresh, last (similarity of the entry at place k, -2 of shorter lists).

    ``edges``: a, b, s, fresh (0 for entries of the lists before, 1 for found ones; an entry that was there before isn't fresh).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["a"]):
            a, b, s, fresh = (t.column(c).to_numpy() for c in ("a", "b", "s", "fresh"))
            order = np.lexsort((fresh, b, a))  # a pair's similarity may differ in the last digits from task to task
            a, b, s, fresh = a[order], b[order], s[order], fresh[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, s, fresh = a[new], b[new], s[new], fresh[new]
            order = np.lexsort((b, -s, a))
            a, b, s, fresh = a[order], b[order], s[order], fresh[order]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            size = np.diff(np.append(first, len(a)))
            place = np.arange(len(a)) - np.repeat(first, size)
            last = np.full(len(first), -2.0)
            last[size >= k] = s[first[size >= k] + k - 1]
            keep = place < k
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[keep], b[keep], s[keep], fresh[keep], np.repeat(last, size)[keep])], names=["a", "b", "s", "fresh", "last"])

    rows = edges.select("a", "b", "s", "fresh").repartition("a").sortWithinPartitions("a")
    return rows.mapInArrow(run, "a long, b long, s double, fresh int, last double")


def descend(graph: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """One round: a, b, s of the pairs of neighbours of a vector that are nearer than the last entry of either list."""
    both = graph.select(F.col("a").alias("hub"), F.col("b").alias("id")).union(graph.select(F.col("b").alias("hub"), F.col("a").alias("id")))
    both = both.repartition("hub").distinct()  # this deal serves the count and its join as well
    # a vector that is everyone's neighbour has its gatherings dealt to parts, chosen by hash, of about 4 k members
    size = both.groupBy("hub").agg(F.ceil(F.count("*") / (4 * k)).cast("int").alias("parts")).where("parts > 1")
    both = both.join(size, "hub", "left").select("hub", "id", F.pmod(F.xxhash64("id", "hub"), F.coalesce("parts", F.lit(1))).cast("long").alias("part"))
    last = graph.groupBy("a").agg(F.first("last").alias("last")).withColumnRenamed("a", "id")
    members = both.join(reps.join(last, "id"), "id").select("hub", "part", "id", "dim", "last", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["hub", "part"]):
            hub, part, ids, last, dims = (t.column(c).to_numpy() for c in ("hub", "part", "id", "last", "dim"))
            edge = np.flatnonzero(np.concatenate(([True], (hub[1:] != hub[:-1]) | (part[1:] != part[:-1]), [True])))
            a, b, s = [], [], []
            raw = t.column("v").combine_chunks()
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if j - i < 2 or (dims[i:j] != dims[i]).any():
                    continue
                x = _unit(raw.slice(i, j - i))
                m = x @ x.T
                np.fill_diagonal(m, -3)
                p, q = np.nonzero(m > last[i:j, None] + 1e-12)
                a.append(ids[i:j][p])
                b.append(ids[i:j][q])
                s.append(m[p, q])
            out = _edges(a, b, s)
            if out.num_rows:  # the same pair meets at several hubs
                pair = np.unique(np.stack([out.column("a").to_numpy(), out.column("b").to_numpy()]), axis=1, return_index=True)[1]
                yield out.take(pa.array(pair))

    rows = members.repartition("hub", "part").sortWithinPartitions("hub", "part", "id")
    return rows.mapInArrow(run, EDGE)


def audit(links: DataFrame, comp: DataFrame, inside: DataFrame, reps: DataFrame, threshold: float, sample: int) -> float:
    """Share of the links of ``sample`` vectors, found by comparison with all rows, that the result has: those of the lists
    (``links``: a, b), and all between members of an enlarged component (``inside``). The lower of the share of all links and of the mean share of a vector.
    """
    picked = reps.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # a fixed number of vectors
    if not picked:
        return 1.0
    shared = reps.sparkSession.sparkContext.broadcast([(r.id, r.dim, bytes(r.v)) for r in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {d for _, d, _ in shared.value}:
            own = [(i, v) for i, e, v in shared.value if e == d]
            x = np.frombuffer(b"".join(v for _, v in own), np.float64).reshape(len(own), d)
            by_dim[d] = np.array([i for i, _ in own]), x / np.linalg.norm(x, axis=1, keepdims=True)
        for b in _batches(batches, 2048):
            ids, dims = b.column("id").to_numpy(), b.column("dim").to_numpy()
            one, two = [], []
            for d, (q, x) in by_dim.items():
                own = np.flatnonzero(dims == d)
                if len(own):
                    s = x @ _unit(b.column("v").take(pa.array(own))).T
                    p, r = np.nonzero(s >= threshold)
                    one.append(q[p])
                    two.append(ids[own][r])
            a, c = np.concatenate(one or [np.empty(0, np.int64)]), np.concatenate(two or [np.empty(0, np.int64)])
            keep = a != c
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(c[keep], pa.int64())], names=["a", "b"])

    true = cut(reps.mapInArrow(run, "a long, b long"))
    have = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct().withColumn("listed", F.lit(True))
    side = lambda x: comp.select(F.col("id").alias(x), F.col("component_id").alias(f"c{x}"))
    whole = inside.select(F.col("component_id").alias("ca")).distinct().withColumn("whole", F.lit(True))
    told = true.join(have, ["a", "b"], "left").join(side("a"), "a", "left").join(side("b"), "b", "left").join(whole, "ca", "left")
    per = told.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("listed") | (F.col("whole") & (F.col("ca") == F.col("cb")))).alias("ok"))
    r = per.agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.avg(F.col("ok") / F.col("n")).alias("mean")).first()
    return min(r.ok / r.n, r.mean) if r.n else 1.0


def _roots(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row of its connected component."""
    root = np.arange(len(link))
    while True:
        low = np.minimum(root, np.where(link, root[None, :], len(link)).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _meet(inside: DataFrame, reps: DataFrame, threshold: float, roots: bool = False) -> DataFrame:
    """All vectors of each component in ``inside`` (component_id, id, copies) meet in pairs of blocks.

    id, links (their multiplicity summed), root (with ``roots``, a vector it is connected to in this pair of blocks): a row for each vector and pair.
    """
    sizes = slim(inside.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = inside.join(sizes, "component_id").select("component_id", "id", "copies", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = dealt.select("component_id", "id", "copies", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).join(reps.select("id", "v"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["component_id", "p", "q"]):
            keys = [t.column(c).to_numpy() for c in ("component_id", "p", "q")]
            ids, copies, own, p, q = (t.column(c).to_numpy() for c in ("id", "copies", "own", "p", "q"))
            edge = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True])))
            raw, out, n, root = t.column("v").combine_chunks(), [], [], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = _unit(raw.slice(i, j - i))
                link = x @ x.T >= threshold
                np.fill_diagonal(link, False)
                if p[i] != q[i]:  # each block meets itself in a task of its own
                    link &= own[i:j, None] != own[None, i:j]
                out.append(ids[i:j])
                n.append(link @ copies[i:j])
                root.append(ids[i:j][_roots(link)] if roots else ids[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(root))], names=["id", "links", "root"])

    rows = rows.repartition("component_id", "p", "q").sortWithinPartitions("component_id", "p", "q", "id")
    return rows.mapInArrow(run, "id long, links long, root long")


def _bridges(inside: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between the components in ``inside``, one for each pair of blocks that has any.

    Saturated lists hold their own component only, so descent may not see these. By the triangle inequality of angles two blocks can be
    linked only if their centres are no further apart than both radii and the threshold's angle; all such blocks are compared.
    """
    sizes = slim(inside.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    rows = inside.join(sizes, "component_id").select("component_id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"), "id").join(reps, "id")
    rows = cut(rows.select(F.xxhash64("component_id", "own").alias("block"), "component_id", "id", "dim", "v"))
    angle = float(np.arccos(np.clip(threshold, -1, 1)))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["block"]):
            block, comp, dim = (t.column(c).to_numpy() for c in ("block", "component_id", "dim"))
            edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            raw, mid, wide = t.column("v").combine_chunks(), [], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = _unit(raw.slice(i, j - i))
                m = x.mean(axis=0)
                m = m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-9 else x[0]
                mid.append(m.tobytes())
                wide.append(float(np.arccos(np.clip(x @ m, -1, 1)).max()))
            at = edge[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(comp[at]), pa.array(dim[at]), pa.array(wide), pa.array(mid, pa.binary())], names=["block", "component_id", "dim", "radius", "v"])

    mids = cut(rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(centre, "block long, component_id long, dim int, radius double, v binary"))
    parts = max(1, -(-mids.count() // BLOCK))
    own = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    dealt = mids.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["dim", "p", "q"]):
            keys = [t.column(c).to_numpy() for c in ("dim", "p", "q")]
            block, comp, radius = (t.column(c).to_numpy() for c in ("block", "component_id", "radius"))
            edge = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True])))
            raw, one, two = t.column("v").combine_chunks(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = _unit(raw.slice(i, j - i))
                r = radius[i:j]
                can = np.arccos(np.clip(x @ x.T, -1, 1)) <= r[:, None] + r[None, :] + angle + 1e-6
                can &= (comp[i:j, None] != comp[None, i:j]) & (block[i:j, None] < block[None, i:j])
                a, b = np.nonzero(can)
                one.append(block[i:j][a])
                two.append(block[i:j][b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], names=["x", "y"])

    pairs = cut(dealt.repartition("dim", "p", "q").sortWithinPartitions("dim", "p", "q", "block").mapInArrow(near, "x long, y long").distinct())
    sides = pairs.select("x", "y", F.col("x").alias("block")).union(pairs.select("x", "y", F.col("y").alias("block")))
    met = sides.join(rows.select("block", "id", "v"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["x", "y"]):
            p, q, block, ids = (t.column(c).to_numpy() for c in ("x", "y", "block", "id"))
            edge = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True])))
            raw, one, two = t.column("v").combine_chunks(), [], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x, left = _unit(raw.slice(i, j - i)), block[i:j] == p[i]
                s = x[left] @ x[~left].T
                at = np.unravel_index(s.argmax(), s.shape)
                if s[at] >= threshold:
                    one.append(ids[i:j][left][at[0]])
                    two.append(ids[i:j][~left][at[1]])
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    return met.repartition("x", "y").sortWithinPartitions("x", "y", "block", "id").mapInArrow(run, "a long, b long")


def _settled(graph: DataFrame, reps: DataFrame, by_v: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the lists say: links (a, b), components (id, component_id), and the members of saturated components (component_id, id, copies)."""
    near = graph.where(F.col("s") >= threshold)
    full = near.where(F.col("last") >= threshold).select(F.col("a").alias("id")).distinct()
    links = near.select("a", "b")
    bridged = False
    while True:
        comp = cut(components(links)).withColumnRenamed("node", "id")
        whole = slim(full.join(comp, "id").select("component_id").distinct())
        inside = saved(comp.join(whole, "component_id").join(by_v.select("id", "copies"), "id").select("component_id", "id", "copies"), "saturated")
        if bridged or inside.select("component_id").distinct().count() < 2:
            return links, comp, inside
        more = cut(_bridges(inside, reps, threshold))
        if more.isEmpty():
            return links, comp, inside
        links, bridged = cut(links.union(more)), True  # all links between the components are known


def near_vectors(vectors: DataFrame, threshold: float = 0.95, k: int = 12, draws: int = 8, recall: float = 0.99, rounds: int = 6, sample: int = 400, doublings: int = 2) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept, recall (what the audit measured, the same in every row; 1 after the exact comparison).

    Null, zero and non-finite vectors, those with null components and rows without vec_id link with nothing and are kept; vectors of
    different lengths don't link. Equal vectors link with each other, rows of one vec_id count as different vectors. Ties go to the
    smallest id. An empty table gives an empty result; labels and other columns are neither used nor returned.
    """
    read = saved(readable(vectors), "vectors")
    seed = 0
    while True:  # classes of equal vectors go by a hash of 64 bits, their bytes decide; another hash if two have the same
        rows = read.withColumn("id", F.xxhash64(F.lit(seed), "v"))
        valid = rows.where("v is not null")
        by_v = saved(valid.groupBy("id", "v", "dim").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")), "classes")
        if by_v.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1
    reps = by_v.select("id", "dim", "v")
    n = reps.count()

    state = lambda df, fresh: df.select("a", "b", "s", F.lit(fresh).alias("fresh"))
    graph, width = cut(shorten(state(first_graph(reps, n, k, draws), 1), k)), k
    for again in range(doublings + 1):
        for _ in range(rounds):
            graph = cut(shorten(state(graph, 0).union(state(descend(graph, reps, width), 1)), width))
            fresh = graph.where("fresh = 1").agg(F.count("*").alias("all"), F.count_if(F.col("s") >= threshold).alias("links")).first()
            if fresh["all"] <= 0.01 * n * width or not fresh["links"]:
                break
        links, comp, inside = _settled(graph, reps, by_v, threshold)
        measured = audit(links, comp, inside, reps, threshold, sample)
        good = measured >= recall
        if good:
            break
        if again < doublings:
            width *= 2
            graph = cut(shorten(state(graph, 0), width))  # the last entry at the new width

    if good:
        enlarged = _meet(inside, reps, threshold).groupBy("id").agg(F.sum("links").alias("links"))
        pairs = links.union(links.select(F.col("b"), F.col("a"))).distinct()
        plain = pairs.join(by_v.select(F.col("id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("links"))
        counted = plain.join(inside.select("id"), "id", "left_anti").union(enlarged)
    else:
        met = saved(_meet(by_v.select(F.col("dim").cast("long").alias("component_id"), "id", "copies"), reps, threshold, roots=True), "met")
        comp, measured = cut(components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))).withColumnRenamed("node", "id"), 1.0
        counted = met.groupBy("id").agg(F.sum("links").alias("links"))
    told = by_v.select("id", "low", "copies").join(comp, "id", "left").join(counted, "id", "left").select("id", "low", F.col("component_id").alias("comp"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    lowest = told.where("comp is not null").groupBy("comp").agg(F.min("low").alias("lowest"))
    told = saved(told.join(lowest, "comp", "left").select("id", "n_links", F.coalesce("lowest", "low").alias("component_id")), "told")
    good = valid.select("vec_id", "id").join(told, "id").select("vec_id", "n_links", "component_id")
    out = good.union(rows.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(float(measured)))
