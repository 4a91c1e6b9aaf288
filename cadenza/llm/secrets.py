"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

DataFrame functions only. Positions come from cutting a text into segments that each end with a match: the lazy gap in
front gives the leftmost match, as a search would, and running lengths give code points.

The battery takes every run of 20 or more characters of the base64 alphabets, infers its encoding (hex, base32, base64),
and tests the symbols for uniformity (chi-squared), for runs above and below the alphabet's middle, and for serial
correlation of neighbours. The three p-values are combined by Bonferroni. A run with letters and digits whose combined p
is at least ``alpha`` is a candidate. How often plain language passes by chance is measured on the corpus itself: runs of
letters only are decoys of their length class (or shorter ones, where a class has few; where these are few as well, pieces
of the corpus's own words, written without gaps), and a class is reported only where decoy rate * runs tested / runs passed is at most ``fdr``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.decontam import let

#: Fixed patterns and least lengths of the scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # whole runs only, as the plain + takes them
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE16 = "0123456789abcdef"

SPAN = "struct<start:int,rank:int,stop:int,word:string>"


def _segments(text: Column, pattern: str) -> Column:
    """The text in pieces that end with a match each; the last piece may have none. Empty if there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(f"(?s).*?(?:{pattern}|\\z)"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _spans(text: Column, pattern: str, rank: int, least: int = 0, group: int = 0, word: bool = False) -> Column:
    """Array of SPAN: the matches whose group has at least ``least`` characters."""

    def step(acc: Column, seg: Column) -> Column:
        stop = acc["at"] + F.length(seg)
        found = F.regexp_extract(seg, pattern, 0)
        ok = (F.length(found) > 0) & (F.length(F.regexp_extract(seg, pattern, group) if group else found) >= least)
        span = F.struct((stop - F.length(found)).cast("int").alias("start"), F.lit(rank).alias("rank"), stop.cast("int").alias("stop"), (found if word else F.lit(None).cast("string")).alias("word"))
        return F.struct(stop.cast("int").alias("at"), F.when(ok, F.concat(acc["spans"], F.array(span.cast(SPAN)))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.aggregate(_segments(text, pattern), zero, step, lambda acc: acc["spans"])


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal (logistic fit, error below 0.0002)."""
    t = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * t + 0.070565 * t * t * t))


def battery(word: Column) -> Column:
    """Combined p-value (double) of the hypothesis that ``word`` is a uniform random string of its inferred encoding.

    Null, and words of fewer than 2 symbols, give null.
    """
    is16 = word.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    is32 = word.rlike("^[A-Z2-7]+=*$")
    alphabet = F.when(is16, BASE16).when(is32, BASE32).otherwise(BASE64)
    plain = F.when(is16, F.lower(word)).otherwise(F.translate(word, "-_=", "+/"))

    def tested(t: Column) -> Column:
        codes = F.transform(F.filter(F.split(t["plain"], ""), lambda c: c != ""), lambda c: F.call_function("locate", c, t["alphabet"]).cast("double") - 1)
        return let(codes, lambda x: _battery(x, F.length(t["alphabet"]).cast("double")))

    # a long word's encoding is found once, not for each of its symbols
    return let(F.struct(plain.alias("plain"), alphabet.alias("alphabet")), tested)


def _squares(x: Column) -> Column:
    """Sum of the squared counts of equal values."""
    zero = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, v: Column) -> Column:
        run = F.when(a["last"] == v, a["run"]).otherwise(0.0)
        return F.struct(v.alias("last"), (run + 1).alias("run"), (a["sum"] + 2 * run + 1).alias("sum"))

    return F.aggregate(F.array_sort(x), zero, step, lambda a: a["sum"])


def _battery(x: Column, k: Column) -> Column:
    n = F.when(F.size(x) >= 2, F.size(x).cast("double"))  # null below, and all that follows
    chi = k / n * _squares(x) - n
    p_uniform = _tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    mid, var = (k - 1) / 2, (k * k - 1) / 12
    high = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v > mid, 1.0).otherwise(0.0))
    walk = lambda f: F.aggregate(x, F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum")), lambda a, v: F.struct(v.alias("last"), (a["sum"] + F.coalesce(f(a["last"], v), F.lit(0.0))).alias("sum")), lambda a: a["sum"])
    runs = 1 + walk(lambda a, v: F.when((a > mid) != (v > mid), 1.0).otherwise(0.0))
    serial = F.abs(walk(lambda a, v: (a - mid) * (v - mid)) / var) / F.sqrt(n - 1)
    return let(F.struct(n.alias("n"), high.alias("high"), runs.alias("runs"), p_uniform.alias("u"), (2 * _tail(serial)).alias("s")), _combined)


def _combined(t: Column) -> Column:
    n, high = t["n"], t["high"]
    mean = 2 * high * (n - high) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(spread > 0, 2 * _tail(F.abs(t["runs"] - mean) / F.sqrt(spread))).otherwise(0.0)
    return F.when(n >= 2, F.least(F.lit(1.0), 3 * F.least(t["u"], p_runs, t["s"])))


def _class(word: Column) -> Column:
    """Length class: half powers of two."""
    return F.floor(2 * F.log2(F.length(word).cast("double"))).cast("int")


#: Words for corpora that have hardly any themselves: language in place of a missing null, not a pattern to find.
PROSE = (
    "the house at the end of the road had been empty for many years before anyone thought of asking who once lived there and why they left "
    "das alte haus am ende der strasse stand schon lange leer bevor jemand fragte wer dort einmal gewohnt hatte und warum er gegangen war "
    "la vieille maison au bout du chemin restait vide depuis longtemps avant que quelqu un demande qui y avait vraiment habité autrefois "
    "la casa vieja al final del camino estaba vacía desde hacía muchos años antes de que alguien preguntara quién había vivido allí"
)


def _uneven(word: Column, alpha: float) -> Column:
    """Whether the uniformity test alone keeps p of a word of letters below ``alpha``, by counting each letter: what language nearly always does, without taking the word apart."""
    n = F.length(word).cast("double")
    counts = [n - F.length(F.replace(word, F.lit(c), F.lit(""))) for c in BASE64[:52]]
    squares = sum((c * c for c in counts[1:]), counts[0] * counts[0])
    chi, k = len(BASE64) / n * squares - n, len(BASE64)
    # hex and base32 have other alphabets: these go to the battery
    return ~word.rlike("^(?:[a-f]+|[A-Z]+)$") & (3 * _tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)) < alpha * 0.999)


def _made(docs: DataFrame, text: str, classes: list[int], alpha: float) -> DataFrame:
    """c, n, ok: counts of decoys made of the letters of all texts and PROSE, and how many pass. For each class all letters of a text are cut into pieces of its least length (512 at most);
    a text with fewer letters is one piece from 20 on; PROSE, as it may be all there is, at four offsets. Runs that may be random themselves, and words that hold digits, give no letters.

    Shorter language passes more often, so what is cut short can only raise the rate.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?<!\S)[^\s0-9]*+[0-9]\S*", " "), RUN, " ")
    letters = lambda t: F.regexp_replace(t, "[^A-Za-z]+", "").alias("t")
    own = docs.where(F.length(text) >= 20).select(letters(plain)).where("length(t) >= 20").withColumn("last", F.lit(0)).union(docs.sparkSession.range(1).select(letters(F.lit(PROSE)), F.lit(3)))
    least = F.least(F.ceil(F.pow(F.lit(2.0), F.col("c") / 2)), F.lit(512)).cast("int")
    rows = own.withColumn("c", F.explode(F.array(*map(F.lit, classes)))).withColumn("n", F.least(least, F.length("t"))).withColumn("k", F.explode(F.sequence(F.lit(0), "last")))
    rows = rows.withColumn("t", F.when(F.col("k") > 0, F.substring("t", F.col("k") * F.floor(F.col("n") / 4).cast("int") + 1, F.length("t"))).otherwise(F.col("t")))
    # the pattern cuts in one pass, where a substring would count its way from the start
    cut = F.regexp_extract_all("t", F.concat(F.lit("[A-Za-z]{"), F.col("n").cast("string"), F.lit("}")), F.lit(0))
    pieces = rows.select("c", F.explode(cut).alias("w"))
    ok = F.when(_uneven(F.col("w"), alpha), F.lit(False)).otherwise(battery(F.col("w")) >= alpha)
    return pieces.select("c", ok.alias("ok")).groupBy("c").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))


def length_classes(docs: DataFrame, text: str = "text", alpha: float = 0.01, fdr: float = 0.05, least_decoys: int = 20) -> list[int]:
    """Length classes in which candidates may be reported. Counts of at most 64 classes reach the driver.

    Where a class and the shorter ones have fewer than ``least_decoys`` decoys, made ones are counted as well: how many long words there are decides no class.
    """
    run = docs.select(F.explode(F.transform(_spans(F.coalesce(F.col(text), F.lit("")), RUN, 3, word=True), lambda s: s["word"])).alias("w"))
    letters = F.col("w").rlike("^[A-Za-z]+$")
    mixed = F.col("w").rlike("[A-Za-z]") & F.col("w").rlike("[0-9]")
    tested = run.select("w", letters.alias("decoy"), mixed.alias("mixed")).where("decoy or mixed").select("decoy", _class(F.col("w")).alias("c"), (battery(F.col("w")) >= alpha).alias("ok"))
    rows = {(r.c, r.decoy): (r.n, r.ok) for r in tested.groupBy("c", "decoy").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).collect()}
    sums, few = 0, []
    for c in sorted({c for c, _ in rows}):
        sums += rows.get((c, True), (0, 0))[0]
        if sums < least_decoys and rows.get((c, False), (0, 0))[1]:
            few.append(c)
    made = {}
    if few:
        made = {r.c: (r.n, r.ok) for r in _made(docs, text, few, alpha).collect()}  # a row per class
    good, decoys, passed = [], 0, 0
    for c in sorted({c for c, _ in rows}):
        n, ok = rows.get((c, True), (0, 0))
        # shorter language passes more often, so what shorter classes add can only raise the rate
        decoys, passed = (n, ok) if n >= least_decoys else (decoys + n, passed + ok)
        more, lucky = made.get(c, (0, 0))
        n, ok = rows.get((c, False), (0, 0))
        if ok and (passed + lucky + 1) / (decoys + more + 1) * n / ok <= fdr:
            good.append(c)
    return good


def scan(docs: DataFrame, text: str = "text", alpha: float = 0.01, fdr: float = 0.05) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of struct(start, rank, stop, word) in code points, end exclusive, by start and kind.

    ``base`` has the fixed patterns (rank 0 to 2: assign, access, hex), ``found`` these and the random strings (3) that
    overlap none of them. Null and empty texts have none. All columns but such as are called base or found stay; repeated
    rows repeat their spans; an empty table gives an empty one.
    """
    rest = docs.drop("base", "found")
    t = F.coalesce(F.col(text), F.lit(""))
    good = length_classes(docs, text, alpha, fdr)
    base = F.array_sort(F.concat(_spans(t, ASSIGN, 0, ASSIGN_LEAST, group=2), _spans(t, ACCESS, 1, ACCESS_LEAST), _spans(t, HEX, 2)))
    out = rest.withColumn("base", base)
    if not good:
        return out.withColumn("found", F.col("base"))
    able = lambda w: w.rlike("[A-Za-z]") & w.rlike("[0-9]") & _class(w).isin(good)
    free = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    drop = lambda s: F.struct(s["start"], s["rank"], s["stop"], F.lit(None).cast("string").alias("word")).cast(SPAN)
    random = F.filter(_spans(t, RUN, 3, word=True), lambda s: able(s["word"]) & free(s) & (battery(s["word"]) >= alpha))
    return out.withColumn("found", F.array_sort(F.concat(F.col("base"), F.transform(random, drop))))


def told(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    kind = lambda r: F.element_at(F.array(*map(F.lit, KINDS)), r + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every text."""
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans")
    )
