"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quoting from abuse.

fit() learns from labelled texts: a lexicon of words and word stems that occur in toxic texts far more than in others, and a
logistic model of what a text has of them (exact terms, misspelled terms, stems, stems for its length, quoted terms, misspelled stems). The lexicon's trie and the Levenshtein
automata of its terms are intersected once into a deterministic automaton over characters, which numpy runs over all words
of a batch side by side; most words are dead after a few characters.

All labelled rows count that aren't held out, and all terms that have enough evidence, each with its misspellings: more terms than one automaton should
hold go to several, of which the nearest term counts. Scoring covers every text in full.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.neardup import _batches

#: Characters that open or close a quotation, and words that report speech, in the languages of the texts.
QUOTES = "\"“”„«»‹›‘’'"
REPORT = frozenset("said says quote quoted quotes called wrote word words term sagte sagt schrieb wort dit écrit mot mots dijo dice palabra escribió".split())
WINDOW = 40
DEAD = 0
#: Terms in one automaton, labels (8 + 4 bytes) that may be broadcast, letters and beginnings a worker holds before it hands them on.
PART, SMALL, HELD = 60, 6_000_000, 4_000_000


def edits_allowed(term: str) -> int:
    """None up to 4 characters, one up to 8, two beyond; of a stem (written with a last *) the characters before the * count."""
    n = len(term.removesuffix("*"))
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """All words within the allowed Levenshtein distance of a term, as a table of transitions.

    A state is the set of (trie node, edits spent) that the characters so far can reach; the characters no term has share
    one class. A stem accepts all words that begin with something within its distance. ``term`` and ``distance`` give for each state the nearest term,
    ties to the first in order. Terms in ``strict`` are allowed no edits.
    """

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        terms = sorted({t for t in terms if t})
        self.terms = terms
        allowed = lambda t: 0 if t in strict else edits_allowed(t)
        spelled = [t.removesuffix("*") for t in terms]
        self.stem = np.array([t.endswith("*") for t in terms], bool)
        self.letters = sorted({c for t in spelled for c in t})
        kind = {c: i + 1 for i, c in enumerate(self.letters)}
        self.width = 1 << 30 if self.stem.any() else max((len(t) + allowed(t) for t in terms), default=0)
        kids: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        room = [0]  # edits any term below allows
        for i, t in enumerate(terms):
            node = 0
            room[0] = max(room[0], allowed(t))
            for c in spelled[i]:
                if kind[c] not in kids[node]:
                    kids[node][kind[c]] = len(kids)
                    kids.append({})
                    ends.append([])
                    room.append(0)
                node = kids[node][kind[c]]
                room[node] = max(room[node], allowed(t))
            ends[node].append(i)

        def close(state: dict[int, int]) -> frozenset:
            """Skipped letters of a term cost an edit; of each node the fewest edits count."""
            todo = list(state)
            while todo:
                n = todo.pop()
                for m in kids[n].values():
                    if (e := state[n] + 1) <= room[m] and e < state.get(m, 99):
                        state[m] = e
                        todo.append(m)
            return frozenset(state.items())

        def step(state: frozenset, c: int) -> frozenset:
            out: dict[int, int] = {}
            for n, e in state:
                if e == 0 and any(self.stem[t] for t in ends[n]):
                    return frozenset({(n, 0)})
                # behind a stem any tail is free
                stay = e if any(self.stem[t] and e <= allowed(terms[t]) for t in ends[n]) else e + 1
                moves = [(n, stay)] + [(m, e + (k != c)) for k, m in kids[n].items()]
                for m, cost in moves:
                    if cost <= room[m] and cost < out.get(m, 99):
                        out[m] = cost
            return close(out)

        first = close({0: 0})
        number = {frozenset(): DEAD, first: 1}
        rows, todo = {DEAD: [DEAD] * (len(self.letters) + 1)}, [first]
        while todo:
            state = todo.pop()
            row = []
            for c in range(len(self.letters) + 1):
                nxt = step(state, c)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            rows[number[state]] = row
        self.table = np.array([rows[i] for i in range(len(rows))], np.int32)
        self.term, self.distance = np.full(len(rows), -1, np.int32), np.zeros(len(rows), np.int8)
        for state, i in number.items():
            best = min(((e, t) for n, e in state for t in ends[n] if e <= allowed(terms[t])), default=None)
            if best:
                self.distance[i], self.term[i] = best
        self.kinds: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kinds": None}  # a megabyte that each worker makes for itself

    @property
    def kind(self) -> np.ndarray:
        if self.kinds is None:
            self.kinds = np.zeros(0x110000, np.uint8 if len(self.letters) < 255 else np.int32)
            for i, c in enumerate(self.letters):
                self.kinds[ord(c)] = i + 1
        return self.kinds

    def find(self, code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, distance) of the words code[start:stop] that are near a term."""
        words = np.flatnonzero((stop - start) <= self.width)
        at, left = start[words].copy(), stop[words] - start[words]
        state = np.ones(len(words), np.int32)
        hit_w, hit_s = [], []
        while len(words):
            state = self.table[state, self.kind[code[at]]]
            at += 1
            left -= 1
            done = (left == 0) & (self.term[state] >= 0)
            if done.any():
                hit_w.append(words[done])
                hit_s.append(state[done])
            live = (left > 0) & (state != DEAD)
            words, at, left, state = words[live], at[live], left[live], state[live]
        w = np.concatenate(hit_w) if hit_w else np.empty(0, np.int64)
        s = np.concatenate(hit_s) if hit_s else np.empty(0, np.int32)
        order = np.argsort(w, kind="stable")
        return w[order], self.term[s[order]], self.distance[s[order]]


class Automata:
    """The same for any number of terms: automata of ``PART`` terms each, the nearest term counts, ties to the first in order."""

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        self.terms = sorted({t for t in terms if t})
        self.first = range(0, max(1, len(self.terms)), PART)
        self.parts = [Automaton(self.terms[i : i + PART], strict) for i in self.first]
        self.stem = np.array([t.endswith("*") for t in self.terms], bool)

    def find(self, code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0].find(code, start, stop)
        found = [a.find(code, start, stop) for a in self.parts]
        w, far = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
        term = np.concatenate([f[1] + i for i, f in zip(self.first, found, strict=True)])
        order = np.lexsort((term, far, w))
        order = order[np.diff(w[order], prepend=-1) != 0]
        return w[order], term[order], far[order]


@lru_cache(maxsize=1)
def automata(terms: tuple[str, ...], strict: frozenset[str]) -> Automata:
    """Those of a model, made once for fitting and scoring."""
    return Automata(list(terms), strict)


_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # weight of evidence
    weights: tuple[float, ...] = (-2.0, 1.0, 0.5, 0.5, 0.5, 0.1, 0.25)  # intercept, exact, misspelled, stems, stems for the length, quoted, misspelled stems
    strict: frozenset[str] = frozenset()  # those that count only as they are spelled


def quoted(text: str, start: int, stop: int) -> bool:
    """Whether the window around a match has a quotation mark before and after it, or a word that reports speech just before."""
    before, after = text[max(0, start - WINDOW) : start], text[stop : stop + WINDOW]
    if any(c in before for c in QUOTES) and any(c in after for c in QUOTES) and not re.search(r"\w[\"“”„«»]\s", before[-3:]):
        return True
    return any(w in REPORT for w in re.findall(r"\w+", before)[-3:])


class Scorer:
    """Finds terms and scores texts in one Python worker."""

    def __init__(self, model: Model, auto: Automata | None = None):
        self.model, self.auto = model, auto or Automata(list(model.terms), model.strict)
        self.value = np.array([model.terms[t] for t in self.auto.terms])

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text the weight of exact terms, misspelled terms, stems, stems per 50 words, quoted ones, misspelled stems (by log1p, so that long texts don't drown others)."""
        out = np.zeros((len(texts), 6))
        held: list[int] = []
        size = 0
        low = [(t or "").lower() for t in texts]
        for i in range(len(low) + 1):
            if i == len(low) or size + len(low[i]) > 1 << 20:
                if held:
                    self._score([low[j] for j in held], held, out)
                held, size = [], 0
            if i < len(low):
                held.append(i)
                size += len(low[i]) + 1
        return np.log1p(out)

    def _score(self, texts: list[str], where: list[int], out: np.ndarray) -> None:
        if not self.auto.terms:
            return
        joined = "\n".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff(np.concatenate(([False], _letters()[code], [False])).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum([len(t) + 1 for t in texts])
        for w, term, far in zip(*(x.tolist() for x in self.auto.find(code, start, stop)), strict=True):
            i = int(np.searchsorted(ends, start[w], side="right"))
            base = int(ends[i]) - len(texts[i]) - 1
            column = 4 if quoted(texts[i], int(start[w]) - base, int(stop[w]) - base) else (5 if far else 2) if self.auto.stem[term] else 1 if far else 0
            out[where[i], column] += self.value[term] / (1 + far)
        words = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(texts))
        out[where, 3] = out[where, 2] / (1 + words / 50)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        b, *w = self.model.weights
        return 1 / (1 + np.exp(-np.clip(b + self.evidence(texts) @ np.array(w), -30, 30)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that fitting must not see: crc32 of the id as text divides by ``folds``. Null ids are held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, bad, good: the different words of toxic and of other texts, those of one group together as far as they meet here."""
    held: dict[int, list[str]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *(pa.array([v[i] for v in held.values()], pa.string()) for i in (0, 1))], names=["g", "bad", "good"])

    for b in batches:
        for y, g, words in zip(*(b.column(c).to_pylist() for c in ("y", "g", "ws")), strict=True):
            pair = held.setdefault(g, ["", ""])
            i = 0 if y > 0 else 1
            size += len(words) - len(pair[i])
            pair[i] = " ".join(sorted({*pair[i].split(), *words.split()})) if pair[i] else words
            size += len(pair[i]) - len(words)
            if size > HELD:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, n, t, whole: of words and their first 3 to 8 letters the groups that have them, have them in a toxic text, and have them as a word; rows come by group."""
    n, t, whole = Counter(), Counter(), Counter()
    heads: dict[str, tuple[str, ...]] = {}

    def of(words: set[str]) -> set[str]:
        out: set[str] = set()
        for w in words:
            if (h := heads.get(w)) is None:
                h = heads[w] = (*(w[:k] for k in range(3, min(len(w), 9))), w)
            out.update(h)
        return out

    def add(bad: set[str], good: set[str]) -> None:
        toxic = of(bad)
        n.update(toxic | of(good))
        t.update(toxic)
        whole.update(bad | good)

    def out() -> Iterator[pa.RecordBatch]:
        names = list(n)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[h] for h in part], pa.int64()) for c in (n, t, whole))], names=["h", "n", "t", "whole"])
        for c in (n, t, whole, heads):
            c.clear()

    last, bad, good = None, set(), set()
    for b in batches:
        for g, x, y in zip(*(b.column(c).to_pylist() for c in ("g", "bad", "good")), strict=True):
            if g != last:
                add(bad, good)
                last, bad, good = g, set(), set()
                if len(n) + len(heads) > HELD // 4:
                    yield from out()
            bad.update(x.split())
            good.update(y.split())
    add(bad, good)
    yield from out()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_fuzzy: int | None = None, least: int = 8) -> Model:
    """Learn from all rows of ``labels`` (doc_id, label) that aren't held out, joined to ``docs`` (doc_id, text).

    ``max_fuzzy``: how many of the strongest terms count with misspellings, for callers that want fewer than all.

    Words and their first 3 to 8 letters are counted. One can become a term when the lower bound (95 %) of its share of toxic groups is
    three times the share of all or half, in ``least`` groups or more. Of a word's beginnings the shortest such one counts, lengthened as
    long as that keeps nine tenths of its toxic groups and its share, or six tenths where the share rises; it is a stem where it mostly begins longer words. A group is the texts of one smallest hash over word triples, so copies count about once. No labels, or no
    toxic ones, give a model without terms. Rows without label or text are left out; of several labels of a doc_id the highest counts.
    """
    pick = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.where("text is not null").join(F.broadcast(pick) if labels.count() <= SMALL else pick, "doc_id").select("y", F.lower("text").alias("text"))
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    triples = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    group = F.array_min(F.transform(F.array(words), triples)[0])  # bound by the outer transform, or each triple would split the text
    kept = F.array_distinct(F.filter(words, lambda w: F.length(w).between(3, 32)))
    seen = rows.select("y", group.alias("g"), F.array_join(kept, " ").alias("ws")).mapInArrow(_gathered, "g long, bad string, good string")
    per = seen.repartition("g").sortWithinPartitions("g").mapInArrow(_beginnings, "h string, n long, t long, whole long")
    per = per.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "t", "whole")]).where(f"n >= {least}")  # whole: groups that have it as a word
    p, z = F.col("t") / F.col("n"), 1.96
    bound = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    share = rows.groupBy("y").count().collect()  # two counts
    base = sum(r["count"] for r in share if r.y) / max(1, sum(r["count"] for r in share))
    good = per.withColumn("bound", bound).where(F.col("bound") >= min(3 * base, 0.5))  # in ``least`` groups each
    good = {r.h: r for r in good.collect()}
    terms, n = _choose(good, base)
    strongest = sorted(terms, key=lambda t: (-terms[t] * np.log(n[t]), t))
    model = Model(terms, strict=frozenset(() if max_fuzzy is None else strongest[max_fuzzy:]))

    auto = automata(tuple(model.terms), model.strict)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model, auto)
        for b in _batches(batches, 512):
            x = s.evidence(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(x[:, i]) for i in range(6))], names=["y", *"abcdef"])

    # a row for each different evidence, as counts
    f = rows.select("y", "text").mapInArrow(features, "y int, " + ", ".join(f"{c} double" for c in "abcdef")).groupBy("y", *"abcdef").count().toPandas()
    if f.empty:
        return model
    x, y, n = f[list("abcdef")].to_numpy(float), f["y"].to_numpy(float), f["count"].to_numpy(float)
    model.weights = tuple(_logistic(x, y, n))
    return model


def _choose(good: dict, base: float) -> tuple[dict[str, float], dict[str, int]]:
    """Terms with their weight of evidence (log odds over those of all rows), and with the groups they are in, from counted beginnings."""
    out: dict[str, float] = {}
    groups: dict[str, int] = {}
    longer_by: dict[str, list] = defaultdict(list)
    within: dict[str, list] = defaultdict(list)
    for g in good.values():
        longer_by[g.h[:-1]].append(g)
        for k in range(1, len(g.h) + 1):
            within[g.h[:k]].append(g)
    taken: set[str] = set()
    for h in sorted(good, key=lambda h: (len(h), h)):
        if any(h[:k] in taken for k in range(3, len(h))):
            continue
        r = good[h]
        if r.bound < 0.5 and any(g.bound >= 0.9 and g.t >= 0.2 * r.t for g in within[h]):
            continue  # a weak beginning that shares some of its words with a strong one must not stand for it
        taken.add(h)
        while longer := [g for g in longer_by[r.h] if g.t >= 0.9 * r.t and g.bound >= r.bound - 0.02]:
            r = max(longer, key=lambda g: (g.t, g.h))
        if purer := [g for g in within[r.h] if g.t >= 0.6 * r.t and g.bound >= r.bound + 0.1]:
            r = max(purer, key=lambda g: (g.bound, len(g.h), g.h))
        odds = float(np.log((r.t + 0.5) / (r.n - r.t + 0.5)) - np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
        name = r.h if r.whole >= 0.8 * r.n else r.h + "*"
        out[name], groups[name] = odds, r.n
    return {t: out[t] for t in sorted(out)}, groups


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Newton steps, halved until the penalised likelihood grows; the ridge pulls towards weights that count a quoted term little, evidence never counts against."""
    a = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array([0.0, 1.5, 1.0, 0.5, 0.5, 0.1, 0.25])
    pull = np.diag([1e-3, *[ridge] * 6])
    w = prior.copy()

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (w - prior) @ pull @ (w - prior) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (n * (p - y)) + pull @ (w - prior)
        h = (a * (n * p * (1 - p))[:, None]).T @ a + pull
        move = np.linalg.solve(h, g)
        while (then := loss(w - move)) > now and np.abs(move).max() >= 1e-9:
            move = move / 2  # where texts part nearly without exception, a full step goes far beyond the minimum
        if then <= now:
            w, now = w - move, then
        if np.abs(move).max() < 1e-9:
            break
    return [float(w[0]), *(float(max(v, 0.0)) for v in w[1:])]


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: double from 0 to 1, higher where toxic is likelier.

    Null and empty texts get the score of a text without terms. A column called as ``out`` is replaced, all others stay;
    repeated rows score alike; an empty table gives an empty one.
    """
    rest = docs.drop(out)
    schema = rest.select("*", F.lit(0.0).alias(out)).schema
    shared = docs.sparkSession.sparkContext.broadcast((model, automata(tuple(model.terms), model.strict)))  # terms and their automata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for b in _batches(batches, 512):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.scores(b.column(text).to_pylist()))], names=[*b.schema.names, out])

    return rest.mapInArrow(run, schema)


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
