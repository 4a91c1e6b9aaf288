"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of the words of trusted text.

A text is the ring of its words and one mark for its two ends, so that every word of it stands once before and once behind
another. With c the count of a bigram, D its discount, t the number of different words before w and cut(v) the discounts of all
bigrams that begin with v,

    p(w | v) = (c - D) / c(v) + cut(v) / c(v) * p(w),    p(w) = (t - D') / T + cut' / T / V

No discount is below FLOOR, so no word has probability 0. A text's log probability is a sum over its different words and bigrams:
log2(cut(w) / c(w) * p(w)) for each word and log2(1 + (c - D) / (cut(v) * p(w))) for each bigram that trusted text has as well. Counts, and
these values, lie in shards by a hash of the n-gram. Each task sends the distinct n-grams of some millions of words, with the numbers of the
texts that have them, to their shards; there they are joined with the values, and sums for each text come back. This
goes in rounds over the shards, which bounds what is on disk at a time. All rows that move are packed arrays.

Cross-fitting: texts are dealt to two folds by a hash that copies share. Trusted texts of a fold make the model for the texts of the other, so
no text is scored by a model that has seen it, and quantiles of trusted texts' perplexities are those of unseen text.

A text is kept if its perplexity is at most the given quantile of its language's trusted texts times a margin.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import shingles
from cadenza.llm.common import discard, fits, helper, release, saved
from cadenza.llm.neardup import _batches
from cadenza.llm.packed import CELL, cells, each_key, floats, met, pack, steps, unpack

FOLDS, FLOOR = 2, 0.1
#: Words a task gathers before it sends them, bytes of text a shard stands for, texts numbered together.
GATHER, SHARD, MANY = 4 << 20, 64 << 20, 1 << 16
ENDS = np.uint64(0x5EED5EED5E)
_K = np.uint64(0x9E3779B97F4A7C15)


def word_ids(hashes: np.ndarray) -> np.ndarray:
    """The ring of a text: its ends, then its words (40 bits)."""
    return np.concatenate(([ENDS], hashes >> np.uint64(24)))


@dataclass(frozen=True)
class Space:
    """Ids of n-grams in 32 to 48 bits, and the shards they lie in. There are 2**12 times as many ids as words, so that hardly any unseen n-gram
    (one of 4096 at most) passes for a seen one, whatever the size.
    """

    bits: int
    shards: int

    @classmethod
    def of(cls, size: int) -> Space:
        """For a corpus of ``size`` bytes, of which a word takes about six."""
        return cls(min(48, max(32, (size // 6).bit_length() + 12)), max(1, -(-size // SHARD)))

    def grams(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return shingles.mix(v * _K + w) >> np.uint64(64 - self.bits)

    def words(self, w: np.ndarray) -> np.ndarray:
        return shingles.mix((w + np.uint64(1)) * _K) >> np.uint64(64 - self.bits)

    def shard(self, ids: np.ndarray) -> np.ndarray:
        return ((ids >> np.uint64(self.bits - 32)) * np.uint64(self.shards)) >> np.uint64(32)

    def cuts(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(shard, begin, end) of the shards that sorted ``ids`` are in."""
        edge = np.searchsorted(self.shard(ids), np.arange(self.shards + 1, dtype=np.uint64)).tolist()
        return [(s, i, j) for s, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i]


def fold_of(hashes: np.ndarray) -> int:
    """By the smallest hash over three words, which copies and most near copies share."""
    if not len(hashes):
        return 0
    n = min(3, len(hashes))
    s = sum(hashes[j : len(hashes) - n + 1 + j] * shingles._TURN[j] for j in range(n))
    return int(shingles.mix(s).min() & np.uint64(1))


def _summed(ids: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ids in order, and the counts of equal ones summed."""
    if not len(ids):
        return (ids, *counts)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return (ids[first], *(np.add.reduceat(c[order], first) for c in counts))


def _counted(trusted: DataFrame, space: Space) -> DataFrame:
    """key (fold * shards + shard), data: the bigrams (v, w, count) of all trusted texts, one row a key, and how many have the counts 1 to 4."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(FOLDS)]

        def rows(fold: int) -> list:
            ring, out = np.concatenate(held[fold]), []
            held[fold].clear()
            v, w = ring, np.concatenate((ring[1:], [ENDS]))
            order = np.lexsort((w, v))  # pairs are told apart in full, ids only say where they go
            v, w = v[order], w[order]
            first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
            n = np.diff(np.append(first, len(v))).astype(np.uint64)
            v, w = v[first], w[first]
            own = space.shard(space.grams(v, w))
            order = np.argsort(own, kind="stable")
            edge = np.searchsorted(own[order], np.arange(space.shards + 1, dtype=np.uint64)).tolist()
            for s, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if j > i:
                    o = order[i:j]  # still in order of the pairs
                    out.append((fold * space.shards + s, 0, 0, pack(steps(v[o]), w[o], n[o])))
            return out

        size = [0] * FOLDS
        for b in _batches(batches, 256):
            for h in shingles.word_hashes(b.column("text").to_pylist()):
                f = fold_of(h)
                held[f].append(word_ids(h))
                size[f] += len(h) + 1
                if size[f] >= GATHER:
                    size[f] = 0
                    yield cells(rows(f))
        for f in range(FOLDS):
            if held[f]:
                yield cells(rows(f))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in each_key(batches):
            parts = [unpack(x) for x in t.column("data").to_pylist()]
            v, w, n = (np.concatenate(x) for x in zip(*((np.cumsum(v), w, n) for v, w, n in parts), strict=True))
            order = np.lexsort((w, v))
            v, w, n = v[order], w[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
            v, w, n = v[first], w[first], np.add.reduceat(n, first)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([pack(steps(v), w, n)], pa.binary()), *(pa.array([int((n == k).sum())]) for k in (1, 2, 3, 4))], names=["key", "data", "n1", "n2", "n3", "n4"])

    return met(trusted.select("text").mapInArrow(gather, CELL), merge, "key long, data binary, n1 long, n2 long, n3 long, n4 long")


def _words(counted: DataFrame, space: Space) -> DataFrame:
    """key, data: of the words of a shard their count, bigrams of count 1, 2 and more that they begin, and words before them; sums for the discounts."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 1):
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                v, w, n = unpack(data)
                v, one = np.cumsum(v), np.ones(len(w), np.uint64)
                zero = np.zeros(len(w), np.uint64)
                is_ = lambda c: c.astype(np.uint64)
                word, *counts = _summed(np.concatenate((v, w)), *(np.concatenate(x) for x in ((n, zero), (is_(n == 1), zero), (is_(n == 2), zero), (is_(n > 2), zero), (zero, one))))
                ids, base = space.words(word), key // space.shards * space.shards
                order, out = np.argsort(ids, kind="stable"), []
                for s, i, j in space.cuts(ids[order]):
                    o = np.sort(order[i:j])
                    out.append((base + s, 0, key, pack(steps(word[o]), *(c[o] for c in counts))))
                yield cells(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in each_key(batches):
            parts = [unpack(x) for x in t.column("data").to_pylist()]
            word, *counts = _summed(*map(np.concatenate, zip(*((np.cumsum(x[0]), *x[1:]) for x in parts), strict=True)))
            before = counts[-1]
            sums = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum()), len(word), int(before.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([pack(steps(word), *counts)], pa.binary()), *(pa.array([x]) for x in sums)], names=["key", "data", "n1", "n2", "n3", "n4", "more", "types", "total"])

    return met(counted.select("key", "data").mapInArrow(part, CELL), merge, "key long, data binary, n1 long, n2 long, n3 long, n4 long, more long, types long, total long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2, 3 and more, from how many n-grams have the counts 1 to 4; none below FLOOR."""
    if not n1:
        return 0.5, 1.0, 1.5
    y, ratio = n1 / (n1 + 2 * n2), lambda a, b: a / b if b else 0.0
    raw = (1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3))
    return tuple(min(max(d, FLOOR), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))


def _taken(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.choose(np.minimum(n, 3).astype(np.int64), (0.0, *d))


@dataclass(frozen=True)
class Sums:
    """What one fold's model needs beside its shards."""

    pair: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word: tuple[float, float, float] = (0.5, 1.0, 1.5)
    total: int = 0  # different bigrams
    rest: float = 1.0  # probability of any one unseen word

    def cut(self, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> np.ndarray:
        return one * self.pair[0] + two * self.pair[1] + more * self.pair[2]

    def p(self, before: np.ndarray) -> np.ndarray:
        return (before - _taken(before, self.word)) / max(self.total, 1) + self.rest


def _sums(counted: DataFrame, words: DataFrame, space: Space) -> list[Sums]:
    """A few numbers for each fold reach the driver."""
    fold = (F.col("key") / space.shards).cast("int")
    add = lambda df, names: {r.f: r for r in df.groupBy(fold.alias("f")).agg(*[F.sum(c).alias(c) for c in names]).collect()}
    pairs, singles, out = add(counted, ["n1", "n2", "n3", "n4"]), add(words, ["n1", "n2", "n3", "n4", "more", "types", "total"]), []
    for f in range(FOLDS):
        if f not in pairs:
            out.append(Sums())
            continue
        a, b = pairs[f], singles[f]
        d = discounts(b.n1, b.n2, b.n3, b.n4)
        left = b.n1 * d[0] + b.n2 * d[1] + b.more * d[2]
        out.append(Sums(discounts(a.n1, a.n2, a.n3, a.n4), d, b.total, left / b.total / (b.types + 1)))
    return out


def _values(counted: DataFrame, words: DataFrame, sums: list[Sums], space: Space) -> DataFrame:
    """key, kind, owner, data: ids and values (float32) of the n-grams of each shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 1):
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                v, w, _ = unpack(data)
                word = np.unique(np.concatenate((np.cumsum(v), w)))
                ids, base = space.words(word), key // space.shards * space.shards
                order = np.argsort(ids, kind="stable")
                yield cells([(base + s, 1, key, pack(steps(np.sort(word[order[i:j]])))) for s, i, j in space.cuts(ids[order])])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in each_key(batches):
            own, *asked = zip(t.column("owner").to_pylist(), t.column("data").to_pylist(), strict=True)
            word, _, one, two, more, before = unpack(own[1])
            word, s = np.cumsum(word), sums[key // space.shards]
            cut, p = s.cut(one, two, more).astype(np.float32), s.p(before).astype(np.float32)
            for owner, data in asked:
                q = np.cumsum(unpack(data)[0])
                at = np.searchsorted(word, q)
                yield cells([(owner, 1, key, pack(steps(q), cut[at], p[at]))])

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in each_key(batches):
            own, *told = t.column("data").to_pylist()
            v, w, n = unpack(own)
            v, s = np.cumsum(v), sums[key // space.shards]
            parts = [(np.cumsum(q), floats(c), floats(p)) for q, c, p in map(unpack, told)]
            word, cut, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(word)
            word, cut, p = word[order], cut[order].astype(float), p[order].astype(float)
            gain = np.log2(1 + (n - _taken(n, s.pair)) / (cut[np.searchsorted(word, v)] * p[np.searchsorted(word, w)]))
            ids = space.grams(v, w)
            order = np.argsort(ids)
            yield cells([(key, 0, 0, pack(steps(ids[order]), gain[order].astype(np.float32)))])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 1):
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                word, c, one, two, more, before = unpack(data)
                s = sums[key // space.shards]
                gain = np.log2(s.cut(one, two, more) / c * s.p(before) / s.rest)
                ids = space.words(np.cumsum(word))
                order = np.argsort(ids)
                # values may be negative: their bits go as they are
                yield cells([(key, 0, 0, pack(steps(ids[order]), gain[order].astype(np.float32)))])

    row = lambda df: df.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("owner"), "data")
    asked = counted.select("key", "data").mapInArrow(ask, CELL)
    told = met(row(words).union(asked), answer, CELL)
    return met(row(counted).union(told), value, CELL).union(words.select("key", "data").mapInArrow(single, CELL))


def _asked(docs: DataFrame, space: Space, rounds: int, turn: int) -> DataFrame:
    """For the shards of a round: n-grams of some texts with the texts' numbers (kind 1), and who these texts are (kind 2).

    ``docs``: a, b (128 bits that tell the row), text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in range(FOLDS)]
        size = [0] * FOLDS

        def rows(fold: int) -> list:
            own, size[fold] = held[fold], 0
            held[fold] = []
            a, b = (np.array([x[i] for x in own], np.int64).view(np.uint64) for i in (0, 1))
            n = np.array([len(x[2]) for x in own], np.uint64)
            name = struct.unpack("<q", hashlib.blake2b(a.tobytes() + b.tobytes() + bytes([fold]), digest_size=8).digest())[0]
            base = (FOLDS - 1 - fold) * space.shards  # the model of the other fold
            mine = [s for s in range(space.shards) if s % rounds == turn]
            out = [(base + mine[name % len(mine)], 2, name, pack(a, b, n, np.array([fold], np.uint64)))]
            ring = np.concatenate([x[2] for x in own])
            who = np.repeat(np.arange(len(own), dtype=np.uint64), n.astype(np.int64))
            ids = np.concatenate((space.words(ring), space.grams(ring, np.concatenate((ring[1:], [ENDS])))))
            both = (ids << np.uint64(16)) | np.concatenate((who, who))
            if rounds > 1:
                both = both[space.shard(ids) % np.uint64(rounds) == turn]
            both, count = np.unique(both, return_counts=True)
            ids, who = both >> np.uint64(16), both & np.uint64(MANY - 1)
            for s, i, j in space.cuts(ids):
                x, d = ids[i:j], who[i:j]
                new = np.concatenate(([True], x[1:] != x[:-1]))
                first = np.flatnonzero(new)
                d = np.where(new, d, np.diff(d, prepend=np.uint64(0)))
                out.append((base + s, 1, name, pack(steps(x[first]), np.diff(np.append(first, j - i)), d, count[i:j])))
            return out

        for batch in _batches(batches, 256):
            for a, b, h in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingles.word_hashes(batch.column("text").to_pylist()), strict=True):
                f = fold_of(h)
                held[f].append((a, b, word_ids(h)))
                size[f] += len(h) + 1
                if size[f] >= GATHER or len(held[f]) >= MANY:
                    yield cells(rows(f))
        for f in range(FOLDS):
            if held[f]:
                yield cells(rows(f))

    return docs.mapInArrow(run, CELL)


def _told(asked: DataFrame, values: DataFrame) -> DataFrame:
    """a, b, fold, n, bits: for each text how many words its ring has, and the values of its n-grams summed."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def rows() -> list:
            out = []
            for name, x in held.items():
                at = np.flatnonzero(x)
                out.append((0, 1, name, pack(steps(at.astype(np.uint64)), x[at].astype(np.float32))))
            held.clear()
            return out

        size = 0
        for _, t in each_key(batches):
            kinds = t.column("kind").to_pylist()
            ids, gain = np.empty(0, np.uint64), np.empty(0)
            for kind, name, data in zip(kinds, t.column("owner").to_pylist(), t.column("data").to_pylist(), strict=True):
                if kind == 0:
                    x, y = unpack(data)
                    ids, gain = np.concatenate((ids, np.cumsum(x))), np.concatenate((gain, floats(y)))
                    order = np.argsort(ids, kind="stable")
                    ids, gain = ids[order], gain[order]
                elif kind == 2:
                    yield cells([(0, 0, name, data)])
                elif len(ids):
                    x, docs, d, count = unpack(data)
                    x = np.cumsum(x)
                    docs = docs.astype(np.int64)
                    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
                    found = np.where(ids[at] == x, gain[at], 0.0)
                    first = np.cumsum(docs) - docs
                    up = np.cumsum(d.astype(np.int64))
                    who = up - np.repeat(up[first] - d[first].astype(np.int64), docs)
                    add = np.bincount(who, weights=np.repeat(found, docs) * count)
                    have = held.get(name)
                    if have is None or len(have) < len(add):
                        size += len(add) - (0 if have is None else len(have))
                        more = np.zeros(len(add))
                        if have is not None:
                            more[: len(have)] = have
                        have = held[name] = more
                    have[: len(add)] += add
                    if size > 1 << 21:
                        size = 0
                        yield cells(rows())
        yield cells(rows())

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in each_key(batches, "owner"):
            data = t.column("data").to_pylist()
            a, b, n, fold = unpack(data[0])
            bits = np.zeros(len(a))
            kinds = t.column("kind").to_pylist()
            for kind, x in zip(kinds, data, strict=True):
                if kind == 1:
                    at, y = unpack(x)
                    bits[np.cumsum(at).astype(np.int64)] += floats(y)
            bits /= kinds.count(0)  # equal rows in equal order, gathered twice, have one name
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), int(fold[0])), pa.int32()), pa.array(n.astype(np.int64)), pa.array(bits)], names=["a", "b", "fold", "n", "bits"])

    answered = met(values.union(asked), answer, CELL)
    return met(answered, total, "a long, b long, fold int, n long, bits double", "owner")


def _keys(text: str = "text"):
    return F.xxhash64("doc_id", text).alias("a"), F.xxhash64(F.lit(1), text, "doc_id").alias("b")


def perplexities(docs: DataFrame, trusted: DataFrame, rounds: int = 3) -> DataFrame:
    """a, b, fold, perplexity: of each row of ``docs`` (doc_id, text) under the model of the other fold's ``trusted`` texts (text).

    a and b, 128 bits of hash of doc_id and text, tell the row; repeated rows come once. Null texts count as empty; of an empty text the end is scored.
    A task that is run again must meet the same rows in the same order, as it does with tables.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    space = Space.of(size)
    rounds = min(rounds, space.shards)
    counted = saved(_counted(trusted.where("text is not null"), space), "bigrams")
    release(spark)
    words = saved(_words(counted, space), "words")
    sums = _sums(counted, words, space)
    values = saved(_values(counted, words, sums, space), "values")
    discard(counted)
    discard(words)
    release(spark)
    keyed = docs.select(*_keys(), "text")
    out = None
    for turn in range(rounds):
        mine = values.where(F.col("key") % space.shards % rounds == turn)
        part = saved(_told(_asked(keyed, space, rounds, turn), mine).withColumn("turn", F.lit(turn)), "sums")
        release(spark)
        out = part if out is None else out.union(part)
    each = out.groupBy("a", "b", "turn").agg(F.max("fold").alias("fold"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    each = each.groupBy("a", "b").agg(F.max("fold").alias("fold"), F.max("n").alias("n"), F.sum("bits").alias("bits"))
    rest = F.element_at(F.array(*[F.lit(float(np.log2(s.rest))) for s in reversed(sums)]), F.col("fold") + 1)
    made = saved(each.select("a", "b", "fold", F.pow(F.lit(2.0), -(F.col("bits") / F.col("n") + rest)).alias("perplexity")), "perplexities")
    release(spark)
    return made


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", quantile: float = 0.995, margin: float = 1.05, least: int = 30, rounds: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with perplexity, threshold and kept.

    Trusted are the documents that ``labels`` marks 1 (one of several labels suffices). The threshold is ``margin`` times the ``quantile`` of the perplexities
    of a language's trusted texts, for each fold, as each has its model; languages with fewer than ``least`` of them, and null ones, take that of all trusted
    texts of the fold. Without trusted text in its fold a text is kept (threshold null). Null and empty texts are scored as empty. Rows without doc_id are
    scored and never trusted. Repeated rows stay repeated and score alike, ties at the threshold are kept; an empty table gives an empty result. Columns of the
    new names are replaced, all others stay, whatever they are called.
    """
    good = saved(labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "trusted")
    rest = docs.drop("perplexity", "threshold", "kept")
    known = F.broadcast(good) if fits(good, 32) else good
    trusted = rest.select("doc_id", "text").join(known, "doc_id", "left_semi")
    scored = perplexities(rest.select("doc_id", "text"), trusted, rounds)
    accuracy = 10_000  # of the quantile sketches, whose size it bounds
    sketch = (F.percentile_approx("perplexity", quantile, accuracy) * margin).alias("q")
    a, b, fold, found, q, r = (helper(rest, x) for x in "abfpqr")
    scored = scored.select(F.col("a").alias(a), F.col("b").alias(b), F.col("fold").alias(fold), F.col("perplexity").alias(found))
    scored = F.broadcast(scored) if fits(scored, 64) else scored
    keyed = rest.select("*", *[k.alias(x) for k, x in zip(_keys(), (a, b), strict=True)]).join(scored, [a, b])
    own = keyed.join(known, "doc_id", "left_semi").select(F.col(fold).alias("fold"), "lang", F.col(found).alias("perplexity"))
    by_lang = own.groupBy("fold", "lang").agg(sketch, F.count("*").alias("n")).where(f"n >= {least} and lang is not null").select(F.col("fold").alias(fold), "lang", F.col("q").alias(q))
    whole = own.groupBy("fold").agg(sketch).select(F.col("fold").alias(fold), F.col("q").alias(r))
    out = keyed.join(saved(by_lang, "thresholds"), [fold, "lang"], "left").join(saved(whole, "thresholds"), fold, "left")
    limit = F.coalesce(q, r)
    return out.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(found).alias("perplexity"), limit.alias("threshold"), (limit.isNull() | (F.col(found) <= limit)).alias("kept"))
