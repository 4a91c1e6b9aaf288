"""The text operators against brute force on small frames with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import zlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import boilerplate, common, decontam, neardup, pieces, quality, secrets, shingles, suffixes, toxicity, vectors, warc
from cadenza.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return ["w" + "".join(chr(97 + int(c)) for c in str(r.randrange(vocabulary))) for _ in range(n)]


def docs_frame(spark, texts, **more):
    data = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOC)


def odd(spark):
    """Rows that every operator must take: null id, null and empty texts, a repeated row, a long text."""
    long = " ".join(words(40_000, 1, 5000))
    data = [(None, "no id here", None, None, None), (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "   \n ", None, "a", 5), (4, "twice", "en", "b", 5), (4, "twice", "en", "b", 5), (5, long, "en", "a", len(long))]
    return spark.createDataFrame(data, DOC)


# components


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            top[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    for few in (0, 40, None):  # contraction to the end, contraction and one task, one task
        got = {r.node: r.component_id for r in common.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_path(spark):
    path = spark.range(2000).selectExpr("id AS a", "id + 1 AS b")
    assert common.components(path, 0).where("component_id <> 0").count() == 0


# 1


def brute_contamination(docs, bench, least=0.75):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    items = {k: split(t) for k, t in bench if split(t)}
    df = collections.Counter(x for w in items.values() for x in set(sh(w)))
    weight = lambda x: 1 + math.log((1 + len(items)) / (1 + df[x]))
    out = {}
    for i, t in docs:
        w = split(t)
        for k, v in items.items():
            own = set(sh(v))
            for at in range(max(1, len(w) - len(v) + 1) if w else 0):
                win = w[at : at + len(v)]
                s = set(sh(win))
                both = sum(map(weight, own & s)) / sum(map(weight, own | s))
                if both >= least:
                    out[i, k] = max(out.get((i, k), 0), both)
    return out


def test_decontamination(spark):
    items = [(k, " ".join(words(n, k + 50))) for k, n in enumerate((15, 20, 30, 40, 60, 40))] + [(6, "short one"), (7, None), (8, ""), (9, "Tab\tand\nline ends too here")]
    texts = []
    for k, t in items[:6]:
        w = t.split()
        edited = w.copy()
        edited[len(w) // 2] = "changed"
        texts += [" ".join(words(30, k) + w + words(30, k + 9)), " ".join(edited), t.upper(), " ".join(words(5, 1) + edited[: len(w) - 1])]
    texts += ["a Short ONE there", "tab and line ends too here", None, "", " ".join(words(100, 77)), " ".join(words(3000, 5) + items[3][1].split())]
    df = docs_frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(df, bench).collect()}
    want = brute_contamination(enumerate(texts), items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = {r.doc_id for r in decontam.decontaminate(df, bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}
    assert decontam.decontaminate(odd(spark), bench).count() == 7
    assert decontam.decontaminate(odd(spark), bench.where("false")).columns == odd(spark).columns
    assert decontam.matches(df.where("false"), bench).count() == 0


def test_windows_between_aligned_starts(spark):
    """Words put in and left out, so that the best window begins where no shingle aligns; similarities on both sides of the bound."""
    r = random.Random(21)
    items = [(k, " ".join(words(r.choice([25, 40, 59]), k + 300, 3000))) for k in range(30)]
    texts = []
    for _, t in items:
        for _ in range(4):
            w = t.split()
            for _ in range(r.randrange(1, 3)):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = words(r.randrange(3), r.randrange(999), 3000)
            texts.append(" ".join(words(r.randrange(12), r.randrange(999), 3000) + w + words(r.randrange(12), r.randrange(999), 3000)))
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.matches(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contamination(enumerate(texts), items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and 10 < len(want) < len(texts)


def test_clashing_names(spark):
    """Columns called as the operators' own ones stay what they are."""
    df = docs_frame(spark, ["menu\nA b c d e f g", "menu\nh i j k l m n", "a b c d e f", None])
    more = {c: F.lit("clash") for c in ("row", "key", "site", "t", "lines", "kept", "common", "__key", "__site", "_lines", "_h", "q", "fold", "n_lines")}
    own = df.withColumns(more)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").withColumns(more)
    left = decontam.decontaminate(own, bench)
    assert left.columns == own.columns and {r.doc_id for r in left.collect()} == {1, 3} and left.first().key == "clash"
    cut = boilerplate.drop_boilerplate(own, names=("n1", "n2", "n3"), ratio=0.1, min_pages=1).collect()
    assert {r.n_lines for r in cut} == {r.key for r in cut} == {r.site for r in cut} == {"clash"}
    assert corpus_pipeline.drop_boilerplate_lines(spark, own, "").where("n_lines = 'clash'").count() == 4


def test_blocks_guarantee_radius():
    r = random.Random(4)
    masks = [m & (1 << 64) - 1 for m in decontam._masks(25)]
    assert sum(masks) == (1 << 64) - 1
    for _ in range(2000):
        x = sum(1 << b for b in r.sample(range(64), 24))
        assert any(not x & m for m in masks)


# 2


@pytest.mark.parametrize("gather,shard", [(8 << 20, 64 << 20), (700, 4000)])
def test_sentencepiece(spark, monkeypatch, gather, shard):
    monkeypatch.setattr(pieces, "GATHER", gather)
    monkeypatch.setattr(pieces, "SHARD", shard)
    codec = pieces.Codec(open(tokenizer_path(), "rb").read())
    parts = [" ", "  ", "a", "foo", "\n", "▁", "é", "漢", "\x00", "🙂", "<s>", "Hello", "\t", "0123", "▁▁"]
    r = random.Random(1)
    texts = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(3000)]
    df = docs_frame(spark, texts).repartition(3).union(odd(spark)).withColumn("ids", F.lit("clash")).withColumn("key", F.lit("own"))
    out = pieces.encode(df, tokenizer_path(), decoded="back")
    assert out.columns == [*(c for c in df.columns if c != "ids"), "ids", "back"]
    rows = out.collect()
    assert len(rows) == 3007 and {x.key for x in rows} == {"own"}
    assert sorted(x.text or "" for x in rows) == sorted([*texts, *(x.text or "" for x in odd(spark).collect())])
    for x in rows:
        ids = codec.sp.encode(x.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(x.ids, "<u4").tolist() == ids and x.back == codec.sp.decode(ids)
    got = {x.doc_id: x for x in pieces.digests(df.where("doc_id > 5"), tokenizer_path()).collect()}
    for i, t in enumerate(texts[6:], 6):
        ids = codec.sp.encode(t, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(codec.sp.decode(ids).encode()).hexdigest()
    assert pieces.digests(odd(spark).where("false"), tokenizer_path()).count() == 0
    two = pieces.decode(out, tokenizer_path(), out="again")
    assert two.where("again <> back").count() == 0


def test_models_that_cross_words(spark, monkeypatch):
    df = odd(spark)
    want = sorted(map(tuple, pieces.digests(df, tokenizer_path()).collect()), key=repr)
    monkeypatch.setattr(pieces, "separable", lambda _: False)
    assert sorted(map(tuple, pieces.digests(df, tokenizer_path()).collect()), key=repr) == want


# 3


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for k, y in enumerate(b):
            q.append(min(p[k + 1] + 1, q[k] + 1, p[k] + (x != y)))
        p = q
    return p[-1]


def test_automaton():
    terms = ["idiot", "moron", "scum", "worthless", "größe", "stem*"]
    auto = toxicity.Automaton(terms)
    r = random.Random(2)
    for _ in range(4000):
        t = list(r.choice(terms).removesuffix("*"))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(t) + 1)
            [lambda: t.insert(k, r.choice("abcxyzö")), lambda: t and t.pop(min(k, len(t) - 1)), lambda: t and t.__setitem__(min(k, len(t) - 1), r.choice("abmx"))][r.randrange(3)]()
        w = "".join(t)
        if not w:
            continue
        code = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        _, _, far = auto.find(code, np.array([0]), np.array([len(w)]))
        want = min([levenshtein(w, x) for x in terms[:5] if levenshtein(w, x) <= toxicity.edits_allowed(x)] + [0] * w.startswith("stem"), default=None)
        assert (int(far[0]) if len(far) else None) == want, w
    assert len(toxicity.Automaton([]).find(np.array([97], np.uint32), np.array([0]), np.array([1]))[0]) == 0


def brute_evidence(text, terms, strict):
    """Weights of the terms near a text's words by kind, straight from the definition."""
    text, out, n = (text or "").lower(), [0.0] * 6, 0
    for m in re.finditer(r"[^\W\d_]+", text):
        n += 1
        near = []
        for t in sorted(terms):
            stem, most = t.removesuffix("*"), 0 if t in strict else toxicity.edits_allowed(t)
            far = min(levenshtein(m[0][:k], stem) for k in range(len(m[0]) + 1)) if t.endswith("*") else levenshtein(m[0], t)
            near += [(far, t)] if far <= most else []
        if not near:
            continue
        far, t = min(near)
        before, after = text[max(0, m.start() - toxicity.WINDOW) : m.start()], text[m.end() : m.end() + toxicity.WINDOW]
        marks = any(c in toxicity.QUOTES for c in before) and any(c in toxicity.QUOTES for c in after) and not re.search(r"\w[\"“”„«»]\s", before[-3:])
        said = marks or bool(toxicity.REPORT & set(re.findall(r"\w+", before)[-3:]))
        out[4 if said else (5 if far else 2) if t.endswith("*") else 1 if far else 0] += terms[t] / (1 + far)
    out[3] = out[2] / (1 + n / 50)
    return [math.log1p(x) for x in out]


def test_evidence():
    terms = {"idiot": 2.0, "moronic": 1.5, "worthless": 3.0, "stinker*": 2.5, "scum": 1.0, "flonkers": 0.7}
    strict = frozenset({"flonkers"})
    model = toxicity.Model(terms, strict=strict)
    r, texts = random.Random(12), [None, "", "idiot"]
    for _ in range(300):
        w = []
        for _ in range(r.randrange(30)):
            x = list(r.choice([*terms, "word", "other", "le"]).removesuffix("*"))
            for _ in range(r.choice([0, 0, 1, 2])):
                x[r.randrange(len(x))] = r.choice("abcdeiou")
            w.append(r.choice(["", "", '"', "said "]) + "".join(x) + r.choice(["", "", "", '"', "ing", ".", "7"]))
        texts.append(" ".join(w))
    got, scores = toxicity.Scorer(model).evidence(texts), toxicity.Scorer(model).scores(texts)
    b, *weights = model.weights
    for t, x, p in zip(texts, got, scores, strict=True):
        want = brute_evidence(t, terms, strict)
        assert np.allclose(x, want), t
        assert abs(p - 1 / (1 + math.exp(-(b + sum(u * v for u, v in zip(weights, want, strict=True)))))) < 1e-9


def test_logistic_stays_finite():
    """Classes that part nearly without exception, as terms do in large tables: full Newton steps run away, and everything or nothing would be toxic."""
    for seed in range(40):
        r = np.random.default_rng(seed)
        n = 20_000
        y = (r.random(n) < 0.1).astype(float)
        x = np.zeros((n, 6))
        x[:, 0] = y * np.log1p(9 * r.integers(1, 6, n)) + (r.random(n) < 0.001) * 2
        x[:, 1:] = (r.random((n, 5)) < 0.01 + 0.3 * y[:, None]) * r.exponential(2, (n, 5))
        x[r.random(n) < 0.02 * y] = 0
        w = toxicity._logistic(x, y, np.ones(n))
        p = 1 / (1 + np.exp(-(w[0] + x @ np.array(w[1:]))))
        assert max(map(abs, w)) < 50 and (p[y == 0] < 0.5).mean() > 0.99 and (p[y == 1] > 0.5).mean() > 0.9


def test_strong_term_below_a_weak_beginning(spark):
    """A beginning that hardly tells (three times the share of all) must not stand for the term that tells for sure."""
    r = random.Random(13)
    texts, labels = [], []
    for i in range(4000):
        bad = i % 10 == 0
        w = words(30, i, 3000) + (["loszer"] if bad and i % 20 == 0 else ["q" + str(i)] if not bad else [])
        if r.random() < (0.5 if bad else 0.035):
            w.append(r.choice(["losa", "losb", "losc", "losd"]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    model = toxicity.fit(docs_frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t.startswith("losz") for t in model.terms) and "los*" not in model.terms, model.terms


def test_terms_beyond_the_fuzzy_ones(spark):
    """Each of 90 terms counts, the weakest as they are spelled; labels that contradict each other give one model."""
    names = ["q" + "".join(chr(97 + int(c)) for c in f"{i * 7919 % 1000:03}") + "zorb" for i in range(90)]
    texts = [" ".join(words(30, i, 3000) + [names[i % 90]] * (i % 2)) for i in range(2700)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(2700)] + [(i, 0) for i in range(0, 2700, 3)], "doc_id long, toxic int")
    model = toxicity.fit(docs_frame(spark, texts), lab, max_fuzzy=20)
    assert model == toxicity.fit(docs_frame(spark, texts), lab.repartition(3), max_fuzzy=20)
    held = [names[i] for i in range(1, 90, 2)]
    s = toxicity.Scorer(model)
    assert len(model.strict) == max(0, len(model.terms) - 20) and (s.scores(held) > s.scores([""])[0]).all()


def test_toxicity(spark):
    r = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        w = words(60, i, 3000)
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["zorblat", "quimpet"]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    df, lab = docs_frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    assert {"zorblat", "quimpet"} <= {t.removesuffix("*") for t in model.terms}
    out = toxicity.digests(df, lab).join(lab, "doc_id").where("held_out").collect()
    assert len(out) > 60 and all(x.predicted == x.toxic for x in out)
    s = toxicity.Scorer(model)
    plain, misspelt, quote = s.scores(["you zorblat zorblat zorblat now", "you zorblatt quimpt zorblaat now", 'he said "zorblat" and "zorblat" and "zorblat" then'])
    clean = s.scores([None])[0]
    assert plain > misspelt >= clean and plain > quote
    assert 0 <= clean < 0.5
    scored = toxicity.score(odd(spark).withColumn("score", F.lit("x")), model)
    assert scored.count() == 7 and scored.agg(F.min("score"), F.max("score")).first()[1] <= 1
    assert toxicity.fit(df, lab.where("false")).terms == {}


def test_all_labelled_rows(spark):
    """A term of eight groups among 32,000 labelled rows: of 20,000 taken by hash it would have had fewer."""
    labelled = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 5]
    named = set(labelled[:: len(labelled) // 8][:8])
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 5), k -> translate(cast(xxhash64(id, k) as string), '-0123456789', 'abcdefghijk'))) as text").repartition(8)
    marks = spark.createDataFrame([(i,) for i in named], "doc_id long").withColumn("more", F.lit(" zorblat"))
    docs = docs.join(marks, "doc_id", "left").select("doc_id", F.concat("text", F.coalesce("more", F.lit(""))).alias("text"))
    labels = spark.range(40_000).join(marks.withColumnRenamed("doc_id", "id"), "id", "left").selectExpr("id as doc_id", "cast(more is not null as int) as toxic")
    model = toxicity.fit(docs, labels)
    assert "zorblat" in {t.removesuffix("*") for t in model.terms}


def test_all_terms_misspelt(spark, monkeypatch):
    """Each of 90 terms counts with an edit, as far as the letters allow; automata of a few terms find what one of all would."""
    names = ["q" + "".join(chr(97 + int(c)) for c in f"{i * 7919 % 1000:03}") + "zorb" for i in range(90)]
    texts = [" ".join(words(30, i, 3000) + [names[i % 90]] * (i % 2)) for i in range(2700)]
    monkeypatch.setattr(toxicity, "PART", 20)
    model = toxicity.fit(docs_frame(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(2700)], "doc_id long, toxic int"))
    assert not model.strict and len(model.terms) > 20
    auto, whole = toxicity.Automata(list(model.terms)), toxicity.Automaton(list(model.terms))
    assert len(auto.parts) > 1 and auto.terms == whole.terms
    r = random.Random(3)
    tried = [n[:k] + r.choice(["", "x", n[k]]) + n[k + 1 :] + r.choice(["", "en"]) for n in names for k in range(len(n))] + [t.removesuffix("*") for t in model.terms]
    code = np.frombuffer(" ".join(tried).encode("utf-32-le"), np.uint32)
    stop = np.cumsum([len(t) + 1 for t in tried]) - 1
    start = stop - [len(t) for t in tried]
    for x, y in zip(auto.find(code, start, stop), whole.find(code, start, stop), strict=True):
        assert len(x) and x.tolist() == y.tolist()


def test_misspelt(spark):
    """Two edits in a long term and one in a stem, with any tail, count: before, neither did."""
    r = random.Random(10)
    tails = ["a", "el", "ous", "ing", "ed", "ity", "um", "ish", "on", "er"]
    texts = [" ".join(words(30, i, 3000) + ([r.choice(["zorblatting", "flonk" + r.choice(tails)]) for _ in range(3)] if i % 4 == 0 else [])) for i in range(600)]
    model = toxicity.fit(docs_frame(spark, texts), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int"))
    assert any(t.endswith("*") and "flonk".startswith(t[:-1]) for t in model.terms) and any(t.removesuffix("*") in "zorblatting" for t in model.terms)
    model = toxicity.Model({"zorblatting": 3.0, "flonk*": 3.0}, toxicity.Model().weights)
    clean, long, stem, other = toxicity.Scorer(model).scores(["you there now", "you zorbblattinng now", "you flomkish now", "you flimkish zrbltinggg now"])
    assert long > clean and stem > clean and other == clean
    auto = toxicity.Automaton(["flonk*", "zorblatting", "quimpetry*"])
    for w in ["flonk", "flomkish", "flnkerous", "fflonking", "zorblattin", "zrblatng", "quimpetrify", "qimpetriest", "quimpqetyy", "qixpetrelse", "zorb", "flo"]:
        code = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        far = auto.find(code, np.array([0]), np.array([len(w)]))[2]
        near = [(min(levenshtein(w[:k], x) for k in range(len(w) + 1)), n) for x, n in (("flonk", 1), ("quimpetry", 2))] + [(levenshtein(w, "zorblatting"), 2)]
        want = min((d for d, n in near if d <= n), default=None)
        assert (int(far[0]) if len(far) else None) == want, w


# 4


def test_warc_appends(spark, tmp_path, monkeypatch):
    pages = lambda a, b: spark.range(a, b).selectExpr("id AS page_id", "'http://a' AS url", "repeat(cast(id % 3 AS string), 2000) AS html")
    path = f"file://{tmp_path}/w"
    warc.archive_pages(pages(0, 10), path)
    monkeypatch.setattr(common, "SMALL_BYTES", -1)
    warc.archive_pages(pages(10, 20), path)
    got = warc.digests(spark, path).collect()
    assert sorted(r.page_id for r in got) == list(range(20)) and {r.payload_bytes for r in got} == {2000}
    assert {(r.page_id, r.refers_to) for r in got} == {(i, None if i % 10 >= 7 else i + (9 - i % 10) // 3 * 3) for i in range(20)}
    # a commit that meets a file of its name takes back what it moved and leaves that file
    w = warc.WarcWriter(f"file://{tmp_path}/c", 1)
    (tmp_path / "c").mkdir()
    for name in ("a.open", "b.open", "b.warc.gz"):
        (tmp_path / "c" / name).write_text(name)
    with pytest.raises(FileExistsError):
        w.commit([warc.Written([(f"{tmp_path}/c/{x}.open", f"{tmp_path}/c/{x}.warc.gz") for x in "ab"])])
    assert [x.name for x in (tmp_path / "c").iterdir()] == ["b.warc.gz"]


def test_warc_head_only():
    import io

    row = dict(record_id="urn:page:1", record_type="response", target_uri="u", date="d", payload_digest="a" * 40, refers_to=None, payload=bytes(range(256)) * 4000)
    data = warc.member(warc.record(row)) * 2
    src = warc._Input(io.BytesIO(data))
    for _ in range(2):
        head, block = warc._member(src, lambda _: True, whole=False)
        assert block.endswith(b"\r\n\r\n") and len(block) < 300 and b"Content-Length: 1024000" in block
    assert warc._member(src, lambda _: True) is False


def test_warc(spark, tmp_path):
    big = "x" * 5000
    data = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/\r\n3", "small"), (4, None, "small"), (5, "u", None), (6, "u", ""), (7, "u", "ü\r\n\r\n" * 900), (7, "u", "ü\r\n\r\n" * 900), (None, "u", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.archive_pages(pages, path)
    got = sorted((tuple(r) for r in warc.digests(spark, path).collect()), key=repr)
    want = []
    for i, _, h in data:
        p = (h or "").encode()
        first = 2 if h == big and i != 2 else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=repr)
    some = warc.read(spark, path).where("record_type = 'response' and target_uri like 'http://a/%'")
    assert {bytes(r.payload) for r in some.collect()} == {big.encode(), b"small"}
    assert "PushedFilters" in some._jdf.queryExecution().toString() or some.count() == 2
    assert warc.read(spark, path, "record_id string").count() == len(data)
    empty = f"file://{tmp_path}/e"
    warc.archive_pages(pages.where("false"), empty)
    assert warc.digests(spark, empty).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    rows = [dict(record_id=f"urn:page:{i}", record_type="response" if i % 3 else "revisit", target_uri="u", date="d", payload_digest="a" * 40, refers_to="urn:page:1", payload=bytes([i]) * i * 3000) for i in range(1, 8)]
    for name, pack in (("a.warc.gz", lambda b: gzip.compress(b)), ("b.warc", lambda b: b), ("c.warc.gz", warc.member)):
        folder = tmp_path / name.replace(".", "_")
        folder.mkdir()
        (folder / name).write_bytes(b"".join(pack(warc.record(r)) for r in rows))
        got = {r.record_id: bytes(r.payload) for r in warc.read(spark, f"file://{folder}").where("record_type = 'response'").collect()}
        assert got == {r["record_id"]: r["payload"] for r in rows if r["record_type"] == "response"}
        one = warc.read(spark, f"file://{folder}").where("record_id = 'urn:page:4'").first()
        assert one.payload_length == 12000 and one.headers["warc-type"] == "response"


# 5


def test_boilerplate(spark, monkeypatch):
    texts = [f"menu\n{' '.join(words(6, i))}\n\nfooter {i % 3}" for i in range(40)] + ["menu\nmenu", None, "", "own line"]
    df = docs_frame(spark, texts).withColumn("n_lines", F.lit("clash"))
    out = {r.doc_id: r for r in boilerplate.drop_boilerplate(df, ratio=0.4, min_pages=3).collect()}
    pages = collections.defaultdict(collections.Counter)
    total = collections.Counter(f"s{i % 2}" for i in range(len(texts)))
    for i, t in enumerate(texts):
        pages[f"s{i % 2}"].update(set((t or "").split("\n")) - {""})
    for i, t in enumerate(texts):
        host = f"s{i % 2}"
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or pages[host][x] <= 0.4 * total[host] or pages[host][x] < 3]
        cut = len(kept) < len(lines) and any(x.strip(" ") for x in kept)
        assert out[i].text == ("\n".join(kept) if cut else t)
        assert (out[i].n_lines, out[i].n_dropped) == (len(lines), len(lines) - len(kept) if cut else 0)
        assert out[i].all_common == (len(kept) < len(lines) and not cut)
    assert any(x.all_common for x in out.values())
    monkeypatch.setattr(common, "SMALL_BYTES", -1)  # lists beyond a broadcast
    assert {r.doc_id: r for r in boilerplate.drop_boilerplate(df, ratio=0.4, min_pages=3).collect()} == out
    urls = spark.createDataFrame([(u,) for u in ("http://A.b/x", "https://u:p@c.d:80?q", "mailto:x@y", None, "")], "url string")
    assert [r[0] for r in urls.select(boilerplate.host_of("url")).collect()] == ["a.b", "c.d", None, None, None]
    assert boilerplate.drop_boilerplate(odd(spark)).count() == 7
    assert boilerplate.drop_boilerplate(df.where("false")).count() == 0


# 6


def brute_spans(t):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    x = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 12]
    x += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(x))


def test_secrets(spark):
    r = random.Random(6)
    bits = ["token", "=", ": ", "secret", "'", '"', " ", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "Password", "api_key", "xyz.", "🙂é", "\n", "apikey", "==", "aaaaaaaaaaaa", "token=password: abcdefghijklmnop"]
    texts = ["".join(r.choices(bits, k=r.randrange(14))) for _ in range(1500)] + [None, "", "a" * 100_000]
    out = {x.doc_id: x for x in secrets.digests(docs_frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert out[i].n_hex == want.count("hex:")
    assert secrets.digests(odd(spark)).count() == 7 and secrets.digests(odd(spark).where("false")).count() == 0


def test_battery(spark):
    r = random.Random(8)
    random_words = ["".join(r.choices(secrets.BASE64, k=40)) for _ in range(200)] + ["".join(r.choices(secrets.BASE16, k=40)) for _ in range(200)]
    prose = ["".join(r.choices(["the", "ing", "and", "tion", "er", "on2"], k=14))[:40] for _ in range(200)] + ["ab" * 20, "0123456789abcdef" * 3]
    df = spark.createDataFrame([(w, i < 400) for i, w in enumerate(random_words + prose)], "w string, good boolean").withColumn("ok", secrets.battery(F.col("w")) >= 0.01)
    rate = {x.good: x.rate for x in df.groupBy("good").agg(F.avg(F.col("ok").cast("double")).alias("rate")).collect()}
    assert rate[True] > 0.95 and rate[False] < 0.05
    texts = [f"plain {w} words" for w in prose[:200]] + [f"key {w} end" for w in random_words[:200]] + [" ".join("".join(r.choices(["the", "ing", "and"], k=14)) for _ in range(5)) for _ in range(100)]
    got = secrets.digests(docs_frame(spark, texts)).where("spans like '%random%'").select("doc_id").collect()
    found = {x.doc_id for x in got}
    assert len(found & set(range(200, 400))) > 180 and len(found - set(range(200, 400))) <= 10


def brute_battery(w):
    """The three tests straight from their formulas."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w):
        letters, w = secrets.BASE16, w.lower()
    elif re.fullmatch("[A-Z2-7]+=*", w):
        letters, w = secrets.BASE32, w.rstrip("=")
    else:
        letters, w = secrets.BASE64, w.replace("-", "+").replace("_", "/").replace("=", "")
    k, x = len(letters), [letters.index(c) for c in w]
    n = len(x)
    if n < 2:
        return None
    tail = lambda z: 1 / (1 + math.exp(1.5976 * (t := max(-8.0, min(8.0, z))) + 0.070565 * t**3))
    chi = sum((c - n / k) ** 2 / (n / k) for c in (x.count(v) for v in range(k)))
    uniform = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    mid, var = (k - 1) / 2, (k * k - 1) / 12
    high = sum(v > mid for v in x)
    runs = 1 + sum((a > mid) != (b > mid) for a, b in zip(x, x[1:]))
    mean = 2 * high * (n - high) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    serial = 2 * tail(abs(sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / var) / math.sqrt(n - 1))
    return min(1.0, 3 * min(uniform, p_runs, serial))


def test_battery_by_hand(spark):
    r = random.Random(14)
    alphabets = [secrets.BASE64, secrets.BASE32, secrets.BASE16, "ABCDEF0123456789", "abcxyz", "A-_b0", "01"]
    ws = ["".join(r.choices(r.choice(alphabets), k=r.randrange(1, 90))) + r.choice(["", "", "=", "=="]) for _ in range(600)]
    df = spark.createDataFrame([(w,) for w in ws], "w string").select("w", secrets.battery(F.col("w")).alias("p"))
    for x in df.collect():
        want = brute_battery(x.w)
        assert (x.p is None) == (want is None) and (want is None or abs(x.p - want) < 1e-6), x.w


def test_random_spans_by_hand(spark):
    """Which spans the battery adds: runs with letters and digits of a reported class, off the fixed patterns, whose p is no lower than alpha."""
    r = random.Random(15)
    word = lambda: r.choice([lambda: "".join(r.choices(secrets.BASE64, k=r.randrange(15, 80))), lambda: "".join(r.choices(["the", "ing", "and", "on2"], k=14)), lambda: "".join(r.choices(["house", "window", "older"], k=9)), lambda: "token=" + "".join(r.choices(secrets.BASE64[:62], k=30))])()
    texts = [" ".join(word() if r.random() < 0.2 else r.choice(["the", "é", "garden"]) for _ in range(30)) for _ in range(200)]
    df = docs_frame(spark, texts)
    good = set(secrets.length_classes(df))
    assert good
    got = {x.doc_id: x.spans for x in secrets.digests(df).collect()}
    for i, t in enumerate(texts):
        spans = [(int(a), int(z), kind) for kind, a, z in (x.split(":") for x in brute_spans(t).split(",") if x)]
        for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t):
            mixed = re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0]) and math.floor(2 * math.log2(len(m[0]))) in good
            if mixed and brute_battery(m[0]) >= 0.01 and not any(a < m.end() and m.start() < z for a, z, k in spans if k != "random"):
                spans.append((m.start(), m.end(), "random"))
        want = sorted(spans, key=lambda x: (x[0], secrets.KINDS.index(x[2])))
        assert got[i] == ",".join(f"{k}:{a}:{z}" for a, z, k in want), t
    assert any("random" in x for x in got.values())


def test_decoys_of_all_texts(spark):
    """Decoys are made of all letters of all texts, none of 2,000 texts and their first letters; they pass as the battery says."""
    r = random.Random(21)
    texts = [" ".join(r.choices(["the", "garden", "Window", "older", "abc9", "é", "of", "x" * 30], k=12)) for _ in range(2_500)] + ["".join(r.choices(secrets.BASE64[:52], k=19)) + " " for _ in range(3)]
    texts += [" ".join("".join(r.choices(secrets.BASE64[:52], k=15)) for _ in range(400)), " ".join(["fade", "bead", "cafe"] * 20), " ".join(["CAFE", "ZEBRA", "QUICK"] * 20), None, ""]
    want = collections.defaultdict(list)
    for t in [*texts, secrets.PROSE]:
        left = re.sub(secrets.RUN, " ", " ".join("" if re.search("[0-9]", w) else w for w in re.split(r"\s", t or "")))
        left = re.sub("[^A-Za-z]+", "", left)
        for c in (9, 11) if len(t or "") >= 20 and len(left) >= 20 else ():
            n = min(math.ceil(2 ** (c / 2)), len(left))
            starts = [k for s in range(4 if t == secrets.PROSE else 1) for k in range(s * (n // 4), len(left) - n + 1, n)]
            want[c] += [brute_battery(left[k : k + n]) >= 0.01 for k in starts]
    got = {x.c: (x.n, x.ok) for x in secrets._made(docs_frame(spark, texts), "text", [9, 11], 0.01).collect()}
    assert got == {c: (len(v), sum(v)) for c, v in want.items()} and got[9][1] > 50


def test_random_keys_without_long_words(spark):
    """Random keys are found where no run of 20 letters gives a decoy, and alike with some; prose alone gives none."""
    r = random.Random(12)
    keys = ["".join(r.choices(secrets.BASE64, k=40)) for _ in range(100)]
    short = lambda n: " ".join(r.choices(["the", "house", "and", "station", "older", "window", "garden"], k=n))
    texts = [f"{short(20)} {k} {short(5)}" for k in keys] + [short(40) for _ in range(50)]
    found = lambda t: {x.doc_id for x in secrets.digests(docs_frame(spark, t)).where("spans like '%random%'").select("doc_id").collect()}
    got = found(texts)
    assert len(got & set(range(100))) > 90 and not got - set(range(100))
    assert found(texts + ["unquestionablyinternationalisation"]) == got
    assert len(found([f"key {k}" for k in keys])) > 90


# 7


def brute_repeats(texts, n=400):
    seen = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        seen.update(t[i : i + n] for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        mark = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffixes(spark):
    r = random.Random(5)
    base = [" ".join(words(150, k)) for k in range(6)]
    texts = list(base) + [base[0], base[1][:700] + "X" + base[1][701:], base[2][100:520] + " ü " + base[3][:399], base[3][:400], "é" * 500, "ab" * 600, "short", None, "", base[4] + base[4]]
    for k in range(40):  # a line of 80 bytes and a passage of 450 in many places
        texts.append(" ".join(words(60, 100 + k)) + base[5][:80] + " ".join(words(60, 200 + k)) + (base[5][100:550] if k % 3 else ""))
    for k in range(30):  # near copies, each with edits of its own
        t = list(base[0])
        for _ in range(2):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    got = {x.doc_id: tuple(x)[1:] for x in suffixes.digests(docs_frame(spark, texts)).collect()}
    for i, want in enumerate(brute_repeats(texts)):
        assert got[i] == want, i
    assert suffixes.digests(odd(spark)).count() == 7 and suffixes.digests(odd(spark).where("false")).count() == 0


def test_split_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    base = " ".join(words(400, 3))
    texts = [" ".join(words(40, k)) + base[300 + k * 7 : 900 + k * 11] + " ".join(words(40, k + 50)) for k in range(30)]
    got = {x.doc_id: tuple(x)[1:] for x in suffixes.digests(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(30)] == brute_repeats(texts)


def test_deep_shallow():
    r = random.Random(5)
    for _ in range(200):
        base = [bytes(r.choices(b"ab", k=60)) for _ in range(2)]
        left, right = [], []
        for _ in range(r.randrange(2, 14)):
            x, y = bytearray(r.choice(base)[: r.randrange(5, 60)]), bytearray(r.choice(base)[: r.randrange(20, 60)])
            for s in (x, y):
                if r.random() < 0.7:
                    s[r.randrange(len(s))] ^= 3
            left.append(bytes(x))
            right.append(bytes(y))
        assert [right[i] for i in suffixes.deep_shallow(right, 4)] == sorted(right)
        k = r.randrange(20, 70)
        want = []
        for i in range(len(left)):
            ok = [(p, q) for j in range(len(left)) if j != i for p, q in [(suffixes.shared(left[i], left[j]), suffixes.shared(right[i], right[j]))] if p + q >= k]
            want.append((max([p for p, _ in ok], default=0), max([q for _, q in ok], default=0)))
        assert suffixes.reaches(left, right, k) == want


# 8


def brute_perplexity(texts, trusted):
    """Interpolated modified Kneser-Ney over rings of words, straight from the formulas."""
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    fold = [quality.fold_of(h) for h in shingles.word_hashes(texts)]
    rings = [[None, *split(t)] for t in texts]
    pairs = lambda r: list(zip(r, r[1:] + r[:1], strict=True))
    models = []
    for f in (0, 1):
        c = collections.Counter(x for i in trusted if fold[i] == f and texts[i] is not None for x in pairs(rings[i]))
        t = collections.Counter(w for _, w in c)
        of = lambda counts: [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        models.append((c, t, quality.discounts(*of(c)), quality.discounts(*of(t))))
    out = []
    for r, f in zip(rings, fold, strict=True):
        c, t, d, e = models[1 - f]
        cut = lambda n, d: d[min(n, 3) - 1] if n else 0.0
        begin, taken = collections.Counter(), collections.Counter()
        for (v, _), n in c.items():
            begin[v] += n
            taken[v] += cut(n, d)
        total = sum(t.values())
        rest = sum(cut(n, e) for n in t.values()) / total / (len(t) + 1) if total else 1.0
        bits = 0.0
        for v, w in pairs(r):
            low = (t[w] - cut(t[w], e)) / max(total, 1) + rest
            p = (c[v, w] - cut(c[v, w], d)) / begin[v] + taken[v] / begin[v] * low if begin[v] else low
            assert p > 0
            bits -= math.log2(p)
        out.append(2 ** (bits / len(r)))
    return out, fold


@pytest.mark.parametrize("shard,gather,rounds", [(64 << 20, 4 << 20, 3), (3000, 500, 2), (1500, 300, 3)])
def test_kneser_ney(spark, monkeypatch, shard, gather, rounds):
    monkeypatch.setattr(quality, "SHARD", shard)
    monkeypatch.setattr(quality, "GATHER", gather)
    texts = [" ".join(words(40, i, 60)) for i in range(90)] + ["A b  a B a b", "a b", None, "", "zz" * 9, "a b", "a b"]
    want, fold = brute_perplexity(texts, range(0, 97, 2))
    assert 0 < sum(fold) < len(fold)
    df = docs_frame(spark, texts)
    df = df.union(df.where("doc_id in (3, 91)"))  # repeated rows
    got = quality.perplexities(df.select("doc_id", "text"), df.where("doc_id % 2 = 0").select("text"), rounds)
    got = {r.doc_id: r.perplexity for r in df.select("doc_id", *[k for k in quality._keys()]).join(got, ["a", "b"]).collect()}
    assert len(got) == 97 and all(abs(got[i] / want[i] - 1) < 1e-5 for i in range(97))


def test_ids_that_collide(spark, monkeypatch):
    """With far too few ids n-grams are taken for others, but no count is lost and nothing ends without a number."""
    monkeypatch.setattr(quality.Space, "of", classmethod(lambda cls, size: cls(32, 3)))
    monkeypatch.setattr(quality.Space, "grams", lambda self, v, w: (shingles.mix(v + w) & np.uint64(63)) << np.uint64(26))
    texts = [" ".join(words(40, i, 60)) for i in range(60)]
    df = docs_frame(spark, texts)
    counted = quality._counted(df.select("text"), quality.Space.of(1)).select("data").collect()
    total = sum(int(quality.unpack(r.data)[2].sum()) for r in counted)
    assert total == 60 * 41
    got = quality.perplexities(df.select("doc_id", "text"), df.select("text")).collect()
    assert len(got) == 60 and all(math.isfinite(r.perplexity) and r.perplexity > 0 for r in got)


def test_packed():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a, b, c = np.sort(r.integers(0, 1 << 48, n, dtype=np.uint64)), r.integers(0, 300, n).astype(np.uint64), r.normal(size=n).astype(np.float32)
        x, y, z = quality.unpack(quality.pack(quality.steps(a), b, c))
        assert (np.cumsum(x) == a).all() and (y == b).all() and (quality.floats(z) == c).all()
    assert all(d >= quality.FLOOR for x in ((5, 0, 0, 0), (1, 9, 0, 0), (0, 3, 1, 1), (10, 1, 9, 9)) for d in quality.discounts(*x))


def test_quality(spark):
    good = [" ".join(words(80, i, 30)) for i in range(150)]
    bad = ["".join(random.Random(i).choices("!@#$%^&*()qzxjkvbw0123456789|~", k=400)) for i in range(20)]
    df = docs_frame(spark, good + bad).withColumn("kept", F.lit("clash")).withColumn("_q", F.lit("own"))
    lab = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(df, lab).collect()}
    assert sum(not out[i].kept for i in range(150)) <= 3 and not any(out[i].kept for i in range(150, 170)) and out[0]._q == "own"
    # thresholds against the perplexities of trusted texts of the fold
    want, fold = brute_perplexity(good + bad, range(100))
    for f in (0, 1):
        own = sorted(want[i] for i in range(100) if fold[i] == f)
        limit = own[math.ceil(0.995 * len(own)) - 1] * 1.05
        assert all(abs(out[i].threshold / limit - 1) < 1e-4 for i in range(170) if fold[i] == f)
    assert quality.classify(odd(spark), lab).count() == 7
    assert quality.classify(df, lab.where("false")).where("not kept").count() == 0
    assert quality.classify(df.where("false"), lab).count() == 0
    # equal trusted texts: one fold has no model, and nothing is scored as impossible
    same = docs_frame(spark, ["the same text for all of them"] * 40 + good[:20])
    out = quality.classify(same, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).collect()
    assert all(math.isfinite(r.perplexity) for r in out) and all(r.kept for r in out if r.doc_id < 40)


# 9


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed=1):
    r = random.Random(seed)
    texts = [None, "", " \n ", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f"]
    for k in range(25):
        base = words(r.randrange(20, 200), k, 5000)
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            w = base.copy()
            for _ in range(r.randrange(1, 3)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
    hot = words(120, 999, 5000)  # a group of near copies of all distances, and documents that share one passage
    for _ in range(120):
        w = hot.copy()
        for _ in range(r.randrange(0, 8)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    passage = words(60, 555, 5000)
    texts += [" ".join(words(60, 3000 + k, 5000) + passage) for k in range(60)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [20_000, 5])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)  # the small number splits first bands
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_frame(spark, texts)).collect()}
    want = brute_components(texts)
    wrong = [i for i, w in enumerate(want) if got[i] != w]
    assert not wrong
    out = neardup.near_duplicates(odd(spark)).collect()
    assert len(out) == 7 and sum(r.component_id is None and r.kept for r in out) == 1
    assert neardup.near_duplicates(odd(spark).where("false")).count() == 0


def test_shingles():
    for t in ["", "  ", "a", "A b\tC d e", " ".join(words(300_000, 2))]:
        h = shingles.word_hashes([t])[0]
        assert len(h) == len(t.split()) and len(np.unique(h)) == len(set(t.lower().split()))
    two = shingles.word_hashes(["x y", "Y X", None, "x y"])
    assert (two[0] == two[3]).all() and (two[0] == two[1][::-1]).all() and len(two[2]) == 0


# 10


def test_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 16))
    for k in range(0, 300, 3):
        x[k + 1] = x[k] + r.normal(size=16) * 0.1
        x[k + 2] = x[k + 1] + r.normal(size=16) * 0.25
    x[600:660] = x[600] + r.normal(size=(60, 16)) * 0.12  # more links than a list holds
    x[700:730] = x[700]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), (1004, []), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (0, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    links = link.sum(axis=1)
    near0 = np.flatnonzero(link[0])
    links[near0] += 1  # the repeated row of vector 0
    links[0] += 1
    top = list(range(900))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in zip(*np.nonzero(link), strict=True):
        p, q = find(a), find(b)
        top[max(p, q)] = min(p, q)
    out = vectors.near_vectors(df, k=8).collect()
    assert len(out) == len(data) and min(v.recall for v in out) >= 0.99
    for row in out:
        if row.vec_id is not None and row.vec_id < 900:
            assert (row.n_links, row.component_id) == (links[row.vec_id], find(row.vec_id)), row
    rest = {row.vec_id: (row.n_links, row.component_id, row.kept) for row in out if row.vec_id is None or row.vec_id >= 1000}
    assert rest[1005][:2] == (1, 1005) and rest[1006][:2] == (1, 1005)
    assert all(rest[k] == (0, k, True) for k in (1000, 1001, 1002, 1003, 1004, None))
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_whole(spark):
    """Links that descent didn't find: the audit sees what is returned, and nothing below its target is returned."""
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 16))
    x[1::2] = x[::2] + r.normal(size=(200, 16)) * 0.08
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    poor = vectors.near_vectors(df, k=1, draws=1, rounds=1, doublings=0).collect()
    assert {v.vec_id: v.n_links for v in poor} == dict(enumerate(links.tolist()))
    assert all(v.component_id == v.vec_id // 2 * 2 for v in poor if v.n_links) and {v.recall for v in poor} == {1.0}  # compared in full


def test_bridges(spark):
    """Two dense groups with one vector of the first between them: the link is found, the own ones are not told."""
    r = np.random.default_rng(5)
    x = np.zeros((81, 16))
    x[:, 0] = 1
    x[40:80, 1] = 0.8
    x[:80] += r.normal(size=(80, 16)) * 0.01
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    x[80] = u[39] + u[40]
    inside = spark.createDataFrame([(i, int(40 <= i < 80), 1) for i in range(81)], "id long, component_id long, copies long")
    reps = spark.createDataFrame([(i, 16, x[i].tobytes()) for i in range(81)], "id long, dim int, v binary")
    got = vectors._bridges(inside, reps, 0.95).collect()
    assert len(got) == 1 and max(got[0]) == 80 and 40 <= min(got[0]) < 80
    assert vectors._bridges(inside.where("id < 80"), reps, 0.95).count() == 0


# the pipeline


def test_pipeline(spark, tmp_path):
    r = random.Random(2)
    bench = [(k, " ".join(words(30, k + 900, 5000))) for k in range(5)]
    texts, labels = [], []
    for i in range(200):
        w = words(50, i, 5000)
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["zorblat", "quimpet"]))
        texts.append("Site menu here\n" + " ".join(w))
        labels.append((i, int(bad)))
    texts += [texts[1], texts[2] + " tail", "intro " + bench[2][1] + " outro", None, "", "  "]
    folder = f"file://{tmp_path}"
    docs = docs_frame(spark, texts).union(spark.createDataFrame([(None, "without id", None, None, None)], DOC))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, folder).collect()}
    want = {i for i in range(200) if i % 4} | {203, 204, 205, None}
    assert set(out) == want
    assert all(x.round_trip for x in out.values()) and out[203].n_tokens == 2
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.where("false"), folder).count() == 0, name
