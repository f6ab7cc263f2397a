"""Tokens, phrases and BM25 as columns."""

from __future__ import annotations

import functools
import math
import operator
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamdex.schema import Schema

# Fixed values of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@functools.cache
def accents() -> tuple[str, str]:
    """Letters with diacritics of one code point, and the letters without."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        plain = unicodedata.normalize("NFD", c)
        if len(plain) > 1 and all(unicodedata.combining(x) for x in plain[1:]) and plain[0].isascii():
            pairs[c] = plain[0]
    return "".join(pairs), "".join(pairs.values())


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and private-use characters, in order; accents are dropped."""
    return F.regexp_extract_all(F.lower(F.translate(text, *accents())), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def length(schema: Schema) -> Column:
    """Tokens over all text fields, of rows that hold the tokens."""
    sizes = [F.coalesce(F.size(F.col(schema.tokens(n))), F.lit(0)) for n, _ in schema.text_fields]
    return functools.reduce(operator.add, sizes, F.lit(0)).cast("long")


def term_tokens(term: str) -> list[str]:
    """The same of a query term, on the driver."""
    plain = term.translate(str.maketrans(*accents())).lower()
    return [t for t in re.split(r"(?:[^\w]|_)+", "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in plain)) if t]


def holds(tokens_: Column, phrase: list[str]) -> Column:
    """Whether the tokens stand next to each other; no token matches nothing."""
    if not phrase:
        return F.lit(False)
    if len(phrase) == 1:
        return F.array_contains(tokens_, phrase[0])
    # tokens hold no spaces, so this is exact
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def occurrences(tokens_: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the tokens, overlaps counted."""
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(tokens_, lambda t: t == phrase[0]))
    n, wanted = len(phrase), F.array(*[F.lit(t) for t in phrase])
    starts = F.when(F.size(tokens_) >= n, F.sequence(F.lit(1), F.size(tokens_) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(tokens_, i, n) == wanted))


def bm25(frequencies: list[tuple[Column, float]], length: Column, average: float) -> Column:
    """Sum over phrases of idf times saturated, length-normalised frequency; higher is better."""
    total = F.lit(0.0)
    for frequency, idf in frequencies:
        norm = K1 * (1 - B + B * length / F.lit(max(average, 1e-9)))
        total = total + F.lit(idf) * (frequency * (K1 + 1)) / (frequency + norm)
    return total


def idf(rows: int, holding: int) -> float:
    return max(math.log((rows - holding + 0.5) / (holding + 0.5)), LEAST_IDF)
