"""Suffix-array dedup: bytes under a 400-byte string that starts anywhere else as well.

A full suffix array of the corpus isn't needed, only the order of suffixes that can share a string of that length. In every
window of ``length`` bytes the smallest hash among its strings of ``SEED`` bytes is an anchor; it depends on the window's bytes
alone, so equal windows have equal anchors at equal offsets. Anchors whose hash occurs once end there. For the others, the
suffixes that start at the anchor and the reversed prefixes that end there, each cut to what a window can reach, are put in
order by deep-shallow sorting: multikey quicksort to a shallow depth, then a blind trie for each group that shares it.
Joining the suffixes from the longest common prefix down, each looks up its neighbours among the reversed prefixes: they
give the longest match to both sides with one partner. Where the two sides sum up to ``length``, the match is removed.

Equal contexts of an anchor (64 bits of fingerprint beside the anchor's 64) enter the sort once, so a passage or a text
that a million documents share costs one suffix; whatever occurs twice is a match without any sorting. An anchor with many
contexts, such as a line that a third of all documents have, is split: a window holds half of what it has beside the anchor
either before or after it, so contexts meet by their anchor and the half after it, and again by the half before it.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import shingles
from cadenza.llm.common import fits, saved
from cadenza.llm.neardup import _batches, _groups

SEED = 64
SHALLOW = 32
BLOCK = 1 << 20
#: Rows of 60 bytes at most that may be broadcast.
SMALL = 100_000
#: Contexts of an anchor from which it is split.
HOT = 256
ROWS_OF = "array<struct<start:int,stop:int>>"


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Branching depths and bytes only; an insertion walks down blindly and reads one stored string."""

    def __init__(self, text: list[bytes]):
        self.text, self.root = text, None

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        s, node = self.text[i], self.root
        byte = lambda d: s[d] if d < len(s) else -1
        while isinstance(node, tuple):
            node = node[1].get(byte(node[0])) or next(iter(node[1].values()))
        other = self.text[node[0]]
        depth = shared(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][byte(node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][byte(depth)] = [i]
            return
        made = (depth, {other[depth] if depth < len(other) else -1: node, byte(depth): [i]})
        if above is None:
            self.root = made
        else:
            above[1][byte(above[0])] = made

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow(text: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``text`` in byte order."""
    out: list[int] = []
    stack = [(list(range(len(text))), 0)]
    while stack:
        group, d = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if d >= shallow:
            trie = BlindTrie(text)
            for i in group:
                trie.add(i)
            out += trie.order()
            continue
        at = {i: text[i][d] if d < len(text[i]) else -1 for i in group}
        pivot = at[group[len(group) // 2]]
        same = [i for i in group if at[i] == pivot]
        stack.append(([i for i in group if at[i] > pivot], d))
        stack.append((same, shallow if pivot < 0 else d + 1))
        stack.append(([i for i in group if at[i] < pivot], d))
    return out


def reaches(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int]]:
    """For different contexts of one anchor (reversed prefix, suffix): how far the best matches of ``length`` and more reach to both sides."""
    n = len(left)
    out = [(0, 0)] * n

    def meet(i: int, j: int, r: int) -> None:
        k = shared(left[i], left[j])
        if k + r >= length:
            out[i], out[j] = (max(out[i][0], k), max(out[i][1], r)), (max(out[j][0], k), max(out[j][1], r))

    if n == 2:
        meet(0, 1, shared(right[0], right[1]))
        return out
    rank, order = [0] * n, deep_shallow(left)
    for k, i in enumerate(order):
        rank[i] = k
    suffix = deep_shallow(right)
    top = list(range(n))  # of each place in suffix order, its set
    sets: dict[int, list[int]] = {k: [rank[i]] for k, i in enumerate(suffix)}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    joins = sorted(((shared(right[suffix[k]], right[suffix[k + 1]]), k) for k in range(n - 1)), reverse=True)
    longest = max(map(len, left))
    for r, k in joins:
        if r + longest < length:
            break
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big, small = sets[a], sets.pop(b)
        for x in small:
            at = bisect.bisect(big, x)
            for y in (at - 1, at):
                if 0 <= y < len(big):
                    meet(order[x], order[big[y]], r)
        for x in small:
            bisect.insort(big, x)
        top[b] = a
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the windows of ``length`` bytes that cross no text's end."""
    places, hashes, w = [], [], length - SEED + 1
    for at in range(0, max(len(data) - length + 1, 0), BLOCK - length):
        part = data[at : at + BLOCK]
        s = shingles.running(part)
        v = shingles.mix((s[SEED:] - s[:-SEED]) * shingles.powers(len(part) + 1)[1][: len(part) - SEED + 1])
        # hash above, place below: the smallest is the leftmost of equal ones
        low = np.uint64((1 << 20) - 1)
        key = (v & ~low) | np.arange(len(v), dtype=np.uint64)
        n = len(v) - w + 1
        if n < 1:
            continue
        full = np.full(-(-len(key) // w) * w, ~np.uint64(0))
        full[: len(key)] = key
        grid = full.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low
        first = np.arange(at, at + n)
        end = ends[np.searchsorted(ends, first, side="right")]
        least = least[first + length <= end].astype(np.int64)
        if len(least):
            least = least[np.concatenate(([True], least[1:] != least[:-1]))]
            places.append(least + at)
            hashes.append(v[least])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, i = np.unique(p, return_index=True)
    return p, h[i]


def _raw(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _chunks(raw: list[bytes], size: int = BLOCK) -> Iterator[list[int]]:
    held, n = [], 0
    for i, t in enumerate(raw):
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(i)
        n += len(t)
    if held:
        yield held


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by doc_id and text: rows equal in both have equal results."""
    return docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("doc"), "text")


def _anchor_table(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 1024):
            raw, ids = _raw(b.column("text")), b.column("doc").to_numpy()
            for own in _chunks(raw):
                joined = b"".join(raw[i] for i in own)
                ends = np.cumsum([len(raw[i]) for i in own])
                p, h = anchors(np.frombuffer(joined, np.uint8), ends, length)
                who = np.searchsorted(ends, p, side="right")
                start = np.concatenate(([0], ends[:-1]))[who]
                left, right = np.minimum(p - start, length - SEED), np.minimum(ends[who] - p, length)
                prints = [hashlib.blake2b(struct.pack("<I", x) + joined[q - x : q + y], digest_size=8).digest() for q, x, y in zip(p.tolist(), left.tolist(), right.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), np.frombuffer(b"".join(prints), np.int64), ids[np.array(own)][who], (p - start).astype(np.int64), left.astype(np.int32), right.astype(np.int32))], names=["h", "f", "doc", "at", "l", "r"])

    return _keyed(docs).select("doc", "text").mapInArrow(run, "h long, f long, doc long, at long, l int, r int")


def _with_texts(docs: DataFrame, other: DataFrame, columns: list[str], small: bool, how: str = "inner") -> DataFrame:
    """``columns`` of ``docs`` joined to ``other`` by doc, with the text as ``packed`` (zstd): texts cross a shuffle compressed."""
    keyed = _keyed(docs)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in _batches(batches, 512):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc"), pa.array([z.compress(t) for t in _raw(b.column("text"))], pa.binary())], names=["doc_id", "doc", "packed"])

    packed = keyed.mapInArrow(squeeze, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc long, packed binary")
    return packed.join(F.broadcast(other) if small else other.hint("merge"), "doc", how).select(*columns, "packed")


def _unpack(column) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in column.to_pylist()]


def _reach_table(places: DataFrame, docs: DataFrame, length: int, small: bool) -> DataFrame:
    """h, f, l, r for the contexts in ``places`` (h, f, hot, doc, at, l, r)."""
    half = (length - SEED + 1) // 2

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda *x: int.from_bytes(hashlib.blake2b(b"".join(x), digest_size=8).digest(), "little", signed=True)
        for b in _batches(batches, 1024):
            raw, out = _unpack(b.column("packed")), []
            for t, h, f, hot, p, x, y in zip(raw, *(b.column(c).to_pylist() for c in ("h", "f", "hot", "at", "l", "r")), strict=True):
                left, right = t[p - x : p][::-1], t[p : p + y]
                if not hot:
                    out.append((h, h, f, left, right))
                    continue
                if y >= SEED + half:
                    out.append((digest(b"r", right[: SEED + half]), h, f, left, right))
                if x >= half:
                    out.append((digest(b"l", left[:half], right[:SEED]), h, f, left, right))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["g", "h", "f", "left", "right"])

    found = _with_texts(docs, places, ["h", "f", "hot", "at", "l", "r"], small)
    cuts = found.mapInArrow(contexts, "g long, h long, f long, left binary, right binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["g"]):
            t = t.combine_chunks()
            g, f = t.column("g").to_numpy(), t.column("f").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            many = np.repeat(np.diff(edge) > 1, np.diff(edge))
            if not many.any():
                continue
            t = t.filter(pa.array(many)).combine_chunks()
            g, f = g[many], f[many]
            left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))).tolist()
            got: list[tuple[int, int]] = []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                got += reaches(left[i:j], right[i:j], length)
            ok = np.array([a + b >= length for a, b in got], bool)
            lr = np.array(got, np.int32).reshape(-1, 2)[ok]
            yield from pa.Table.from_arrays([t.column(c).filter(pa.array(ok)) for c in ("h", "f")] + [pa.array(lr[:, 0]), pa.array(lr[:, 1])], names=["h", "f", "l", "r"]).to_batches()

    rows = cuts.repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "h long, f long, l int, r int")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (removed byte ranges in order), kept (binary).

    Null texts count as empty; texts below ``length`` bytes lose nothing. Repeated rows are copies of each other. What is left may end
    inside a character, so it is binary. Null doc_ids are allowed. An empty table gives an empty result; other columns
    are left out, so their names can't clash. Ties don't matter: of equal strings each occurrence goes.
    """
    if length <= SEED:
        raise ValueError(f"length must be above {SEED}")
    table = saved(_anchor_table(docs, length), "anchors")
    often = table.groupBy("h").agg(F.count("*").alias("__n"), F.min("f").alias("__a"), F.max("f").alias("__z")).where("__n > 1").select("h", (F.col("__a") != F.col("__z")).alias("differ"))
    # a table of its own, so that the join's sides are plain shuffles and adaptive execution may split a hot anchor's rows
    often = saved(often, "often")
    table = saved(table.join(F.broadcast(often) if fits(often, 48) else often.hint("merge"), "h"), "repeated")
    # contexts that occur again match as a whole; such as differ within an anchor are sorted, one of each
    each = table.groupBy("h", "f").agg(F.count("*").alias("n"), F.first("differ").alias("differ"), F.first("doc").alias("doc"), F.first("at").alias("at"), F.first("l").alias("l"), F.first("r").alias("r"))
    each = saved(each, "contexts")
    hot = each.where("differ").groupBy("h").agg(F.count("*").alias("n")).where(f"n > {HOT}").select("h", F.lit(True).alias("hot"))
    places = saved(each.where("differ").join(hot, "h", "left").select("h", "f", F.coalesce("hot", F.lit(False)).alias("hot"), "doc", "at", "l", "r"), "places")
    sorted_ = _reach_table(places, docs, length, places.count() <= SMALL)
    again = each.where(f"n > 1 and l + r >= {length}").select("h", "f", "l", "r")
    reach = saved(sorted_.union(again).groupBy("h", "f").agg(F.max("l").alias("rl"), F.max("r").alias("rr")), "reach")
    spans = table.select("h", "f", "doc", "at").join(F.broadcast(reach) if fits(reach, 64) else reach.hint("merge"), ["h", "f"]).select("doc", (F.col("at") - F.col("rl")).cast("int").alias("start"), (F.col("at") + F.col("rr")).cast("int").alias("stop"))
    spans = saved(spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("raw")), "spans")
    small = (spans.agg(F.sum(F.size("raw"))).first()[0] or 0) <= SMALL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 512):
            n, spans, kept = [], [], []
            for t, ranges in zip(_unpack(b.column("packed")), b.column("raw").to_pylist(), strict=True):
                out: list[list[int]] = []
                for x in ranges or ():
                    if out and x["start"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x["stop"])
                    else:
                        out.append([x["start"], x["stop"]])
                n.append(len(t))
                spans.append([{"start": a, "stop": z} for a, z in out])
                edges = [0, *(x for s in out for x in s), len(t)]
                kept.append(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    all_ = _with_texts(docs, spans, ["doc_id", "raw"], small, "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return all_.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans {ROWS_OF}, kept binary")


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    r = remove_repeats(docs.select("doc_id", "text"), length)
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
