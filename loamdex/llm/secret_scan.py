"""Secrets in texts: three base patterns, and a battery of randomness tests on the strings they miss.

DataFrame functions only. Every candidate string gets an encoding by its characters: decimal, hex, base32, letters of one
case with digits (base36), or base64 and its URL form. The null hypothesis is ordinary text in that encoding: words of four
languages, joined or with separators, with a number here and there; padded, counted or dated numbers; words of hex digits.
Three tests look the other way:

* chi-squared alphabet uniformity, as the share of pairs of equal symbols, which the statistic is a linear function of:
  ordinary text uses few symbols much, so a random string has a small one;
* runs of character classes (upper, lower, digit; halves of the digits in a decimal string): ordinary text changes class
  seldom, so a random string has many runs;
* serial correlation at lag one, of symbol values in numbers, of vowels in letters: numbers go on as they went, vowels
  and consonants take turns, and neighbours of a random string have nothing to do with each other.

Each statistic is measured from its mean in ordinary text of the encoding, in spreads that shrink with length as a
statistic's own and its variation from text to text do. The three scores are added with fixed weights and divided by
the spread of that sum under their correlations in ordinary text, and by how far its tail reaches beyond a normal one. A
weighted Benjamini-Hochberg rule over all candidates of all documents, whose weights grow with length and are scaled to
mean one, keeps the false-discovery rate at the level asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.common import cut, let

# The base patterns and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Strings that the battery tests.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Runs this short can't pass a base rule; equal to HEX and ACCESS with shorter matches dropped, as both match whole runs.
_HEX_LONG, _ACCESS_LONG = r"[0-9a-f]{16,}", r"AKIA[A-Z0-9]{14,}"
#: Weights of uniformity, runs and serial correlation.
WEIGHTS = (0.5, 1.0, 0.25)
#: By encoding, what ordinary text was measured to have (strings of 20 to 160 characters, made as said above from the words
#: of the test tables): its pattern; of equal pairs, changes of class and serial correlation the mean, the spread
#: from text to text and the spread of one symbol; whether random strings have more of it; correlations of the scores
#: (first with second, first with third, second with third); how far the tail reaches beyond a normal one.
ENCODINGS = {
    "decimal": ("[0-9]+", ((0.223, 0.110, 0.637, -1), (0.263, 0.119, 0.415, 1), (0.319, 0.295, 0.333, -1)), (0.21, 0.02, 0.90), 0.9),
    "hex": ("[0-9a-f]+|[0-9A-F]+", ((0.305, 0.121, 0.730, -1), (0.135, 0.089, 0.207, 1), (0.235, 0.337, 0.001, -1)), (-0.10, 0.67, 0.09), 0.85),
    "base32": ("[A-Z2-7]+", ((0.083, 0.001, 0.115, -1), (0.016, 0.007, 0.168, 1), (-0.208, 0.033, 0.866, 1)), (0.15, 0.08, 0.0), 1.45),
    "lower36": ("[a-z0-9]+", ((0.076, 0.001, 0.120, -1), (0.030, 0.009, 0.216, 1), (-0.180, 0.038, 0.886, 1)), (0.50, 0.20, 0.22), 1.2),
    "upper36": ("[A-Z0-9]+", ((0.068, 0.003, 0.090, -1), (0.061, 0.015, 0.134, 1), (-0.150, 0.040, 0.858, 1)), (0.57, 0.17, 0.15), 1.5),
    "base64": (".*", ((0.068, 0.007, 0.094, -1), (0.174, 0.110, 0.437, 1), (-0.183, 0.040, 0.833, 1)), (0.57, 0.21, 0.09), 0.9),
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Matches that are added up in one go.
_CHUNK = 512
KINDS = ("assign", "access", "hex", "random")


def _spans(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the matches: split() gives what lies between them, so lengths add up to places.

    Lengths are added up within chunks of matches, then over the chunks, so that time is in proportion to the matches.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    parts = F.arrays_zip(found.alias("m"), groups.alias("g"), between.alias("b"))

    def add(s, p):
        start = s["at"] + p["b"]
        end = start + F.length(p["m"])
        hit = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(p["g"]) >= least, F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    def place(every):
        # what stands behind the last match has no match
        count = F.size(every) - 1
        heads = F.sequence(F.lit(1), count, F.lit(_CHUNK))
        chunks = F.transform(heads, lambda h: F.aggregate(F.slice(every, h, F.least(F.lit(_CHUNK), count - h + 1)), state, add))

        def shift(done):
            none = F.array().cast("array<int>")
            sums = F.struct(F.lit(0).alias("at"), none.alias("out"))
            before = F.aggregate(done, sums, lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
            moved = F.zip_with(done, before, lambda c, at: F.transform(c["out"], lambda x: F.struct((x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end"), x["value"].alias("value"))))
            return F.flatten(moved)

        return let(chunks, shift)

    # texts without a match, nearly all, cost one scan
    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, place)).otherwise(empty)


def _overlapped(found: Column, start: Column, end: Column) -> Column:
    """Whether one of these spans, of one kind and so in order and apart, overlaps start..end: a binary search."""
    state = F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi"))

    def halve(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(found, mid)["start"] < end
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(31)), state, halve, lambda s: s["lo"])
    return F.when(F.size(found) == 0, F.lit(False)).otherwise(let(last, lambda k: (k > 0) & (F.get(found, k - 1)["end"] > start)))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17, error below 1e-7 of the density)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _equal_pairs(body: Column, n: Column) -> Column:
    """Share of pairs of equal symbols; the chi-squared statistic of k symbols is k * (n - 1) * share + k - n."""
    # of every distinct symbol, how many the string loses without it
    pairs = F.aggregate(F.array_distinct(F.split(body, "")), F.lit(0.0), lambda a, c: let(n - F.length(F.replace(body, c, F.lit(""))), lambda x: a + x * (x - 1)))
    return pairs / (n * (n - 1))


def _changes(body: Column, decimal: Column) -> Column:
    """Changes of class by neighbours; what joins words and paths is left out, so they change class as seldom as text does."""
    upper, digits = _LETTERS.upper(), "0123456789"
    halves = F.translate(body, digits, "l" * 5 + "u" * 5)
    classes = F.when(decimal, halves).otherwise(F.translate(body, _LETTERS + upper + digits + "+/_-=", "l" * 26 + "u" * 26 + "d" * 10))
    return let(classes, lambda c: F.greatest(F.lit(0.0), F.regexp_count(c, F.lit("l+|u+|d+")) - 1.0) / F.greatest(F.lit(1), F.length(c) - 1))


def _turns(body: Column, n: Column) -> Column:
    """Serial correlation of vowels at lag one; 0 where all symbols are alike."""
    marks = F.regexp_replace(F.regexp_replace(body, "(?i)[aeiouy]", "!"), "[^!]", ".")

    def correlation(m):
        ones = F.regexp_count(m, F.lit("!")).cast("double")
        mean = ones / n
        both = ones - F.regexp_count(m, F.lit("!+"))
        ends = F.startswith(m, F.lit("!")).cast("double") + F.endswith(m, F.lit("!")).cast("double")
        return F.when((ones == 0) | (ones == n), F.lit(0.0)).otherwise((both - mean * (2 * ones - ends) + (n - 1) * mean * mean) / (ones * (1 - mean)))

    return let(marks, correlation)


def _values(body: Column, n: Column) -> Column:
    """Serial correlation of the values of digits at lag one; 1 where all are alike."""
    numbers = F.transform(F.split(F.lower(body), ""), lambda c: F.instr(F.lit("0123456789abcdef"), c).cast("double"))

    def correlation(x):
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

        def around(m):
            state = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("all"))
            step = lambda s, v: F.struct((v - m).alias("before"), (s["lag"] + s["before"] * (v - m)).alias("lag"), (s["all"] + (v - m) * (v - m)).alias("all"))
            return F.aggregate(x, state, step, lambda s: F.when(s["all"] < 1e-9, F.lit(1.0)).otherwise(s["lag"] / s["all"]))

        return let(mean, around)

    return let(numbers, correlation)


def _battery(value: Column) -> Column:
    """The combined z-score of a candidate; high for random strings."""

    def tested(body):
        n = F.greatest(F.length(body), F.lit(2)).cast("double")
        decimal, number = F.regexp_like(body, F.lit("^[0-9]*$")), F.regexp_like(body, F.lit("^([0-9a-f]*|[0-9A-F]*)$"))
        facts = F.struct(n.alias("n"), _equal_pairs(body, n).alias("x0"), _changes(body, decimal).alias("x1"), F.when(number, _values(body, n)).otherwise(_turns(body, n)).alias("x2"))

        def combined(f):
            out = None
            for pattern, tests, (r01, r02, r12), tail in ENCODINGS.values():
                a, b, c = WEIGHTS
                spread = tail * math.sqrt(a * a + b * b + c * c + 2 * (a * b * r01 + a * c * r02 + b * c * r12))
                scores = [(f[f"x{i}"] - mean) * sign / F.sqrt(F.lit(between**2) + F.lit(own**2) / f["n"]) for i, (mean, between, own, sign) in enumerate(tests)]
                z = sum(w * F.greatest(F.lit(-12.0), F.least(F.lit(12.0), x)) for w, x in zip(WEIGHTS, scores, strict=True)) / spread
                out = F.when(F.regexp_like(body, F.lit(f"^({pattern})$")), z) if out is None else out.when(F.regexp_like(body, F.lit(f"^({pattern})$")), z)
            return out

        return let(facts, combined)

    return F.when(F.length(F.rtrim(value, F.lit("="))) < 2, F.lit(-8.0)).otherwise(let(F.rtrim(value, F.lit("=")), tested))


def _label(s: Column) -> Column:
    names = F.element_at(F.array(*[F.lit(x) for x in KINDS]), s["kind"] + 1)
    return F.concat_ws(":", names, s["start"].cast("string"), s["end"].cast("string"))


def scan(docs: DataFrame, false_discovery: float = 0.01) -> DataFrame:
    """Secret spans of every document.

    docs: doc_id, text; other columns are ignored. A null text is the empty text and has no spans. Repeated rows are
    scanned each by itself; empty tables give no rows. Returns doc_id, n_assign, n_access, n_hex, n_random, base (the
    base spans), spans (all spans, strings kind:start:end in code points by start, then kind, comma-joined). Base
    spans follow the patterns alone; the battery only adds strings that no base span overlaps.

    Text is read once and never shuffled. What the rule over all documents needs is a histogram of z-scores by length
    class of fixed size, from which the threshold follows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    found = found.select(
        "doc_id",
        _spans(F.col("_t"), ASSIGN, 0, 2, LEAST["assign"]).alias("assign"),
        _spans(F.col("_t"), _ACCESS_LONG, 1).alias("access"),
        _spans(F.col("_t"), _HEX_LONG, 2).alias("hex"),
        _spans(F.col("_t"), CANDIDATE, 3).alias("tried"),
    )
    kinds = ("assign", "access", "hex")
    base = F.array_sort(F.transform(F.concat(*kinds), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    clear = F.filter("tried", lambda c: ~(_overlapped(F.col("assign"), c["start"], c["end"]) | _overlapped(F.col("access"), c["start"], c["end"]) | _overlapped(F.col("hex"), c["start"], c["end"])))
    scored = F.transform(
        clear,
        lambda c: F.struct(
            c["start"].alias("start"),
            c["kind"].alias("kind"),
            c["end"].alias("end"),
            F.round(F.greatest(F.lit(-8.0), F.least(F.lit(30.0), _battery(c["value"]))), 2).alias("z"),
        ),
    )
    found = cut(found.select("doc_id", base.alias("base"), scored.alias("tried")))
    limit = _threshold(found, false_discovery)
    kept = F.filter(F.col("tried"), lambda c: c["z"] >= F.element_at(F.col("limits"), _length_class(c) + 1))
    kept = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    out = found.crossJoin(F.broadcast(limit)).withColumn("more", kept)  # one row of fixed size
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("more").cast("long").alias("n_random"),
        F.array_join(F.transform("base", _label), ",").alias("base"),
        F.array_join(F.transform(F.array_sort(F.concat("base", "more")), _label), ",").alias("spans"),
    )


def _length_class(c: Column) -> Column:
    """0 to 4: the length of a candidate, doubling from 20."""
    return F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.log2((c["end"] - c["start"]) / 20.0)))).cast("int")


def _threshold(found: DataFrame, level: float) -> DataFrame:
    """One row, limits array<double>: the least z that counts, by length class.

    Weighted Benjamini-Hochberg: with q = p / w, w by length class with mean one over the candidates, the largest q for
    which q * m <= level * (candidates of at most q) is kept; steps are those of the rounded z-scores.
    """
    flat = found.select(F.explode("tried").alias("c")).select(_length_class(F.col("c")).alias("size"), F.col("c.z").alias("z"))
    # at most 5 classes times the rounded scores: a table of fixed size
    counts = flat.groupBy("size", "z").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("size") + 1)).alias("weight"))
    q = counts.crossJoin(F.broadcast(total)).withColumn("q", F.least(F.lit(1.0), _tail(F.col("z")) * F.col("weight") / (F.col("m") * (F.col("size") + 1))))
    upto = F.sum("n").over(Window.orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    best = q.withColumn("upto", upto).filter(F.col("q") * F.col("m") <= level * F.col("upto")).agg(F.max("q").alias("best"))
    least = q.crossJoin(F.broadcast(best)).filter(F.col("q") <= F.col("best")).groupBy("size").agg(F.min("z").alias("z"))
    none = F.lit(float("inf"))
    return least.agg(F.array(*[F.coalesce(F.min(F.when(F.col("size") == i, F.col("z"))), none) for i in range(5)]).alias("limits"))
