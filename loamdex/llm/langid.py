"""Language ID by unigrams whose segmentation is summed out.

Each language has a probability for every piece of a fixed public vocabulary, fitted by expectation maximisation. The
probability of a word is the sum over all ways to cut it into pieces, which the forward algorithm adds up; that of a
text is the product over its words. Words are lower-cased runs of letters, each scored once per worker.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm.common import give_back
from loamdex.llm.lattice import SPACE, PieceTable, backward, by_length, forward, log_backward, log_forward, of_like_length, vocabulary

#: Sums of longer words are held as logarithms; they would underflow otherwise. Such words are scored anew in every batch.
LONGEST = 32
UNKNOWN = 1e-7
REMEMBERED = 300_000
_letters = re.compile(r"[^\W\d_]+").findall
_WORKERS: dict[str, Scorer] = {}


def words_of(text: str) -> list[str]:
    return _letters(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def log_marginals(words: list[str], table: PieceTable, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, (words, languages), summed over all its segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    long = np.array([len(w) >= LONGEST for w in words], dtype=bool)
    few, many = np.flatnonzero(~long), np.flatnonzero(long)
    for at, codes in by_length([SPACE + words[i] for i in few.tolist()]):
        out[few[at]] = np.log(forward(table.arcs(codes), p)[-1])
    for at, codes, lengths in of_like_length([SPACE + words[i] for i in many.tolist()]):
        out[many[at]] = log_forward(codes, lengths, table, p)
    return out


class Model:
    """Languages, their priors and their pieces' probabilities: pieces + 2 rows, the last for unknown characters."""

    def __init__(self, languages: list[str], priors: np.ndarray, p: np.ndarray):
        self.languages, self.priors, self.p, self.name = languages, priors, p, uuid.uuid4().hex


def fit(counts: dict[str, dict[str, int]], docs: dict[str, int], rounds: int = 3, smooth: float = 0.1) -> Model:
    """counts: word counts by language; docs: documents by language, for the priors."""
    pieces, _, ranks = vocabulary()
    table = PieceTable(pieces)
    languages = sorted(counts)
    n, k = table.size, len(languages)
    start = 1.0 / (np.array(ranks, dtype=np.float64) + 50.0)
    p = np.zeros((n + 2, k))
    p[:n] = (start / start.sum())[:, None]
    p[n + 1] = UNKNOWN
    words = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[c].get(w, 0) for c in languages] for w in words], dtype=np.float64).reshape(len(words), k)
    long = np.array([len(w) >= LONGEST for w in words], dtype=bool)
    few, many = np.flatnonzero(~long), np.flatnonzero(long)
    for _ in range(rounds if words else 0):
        expected = np.zeros((n + 2, k))

        def count(piece: np.ndarray, use: np.ndarray, expected: np.ndarray = expected) -> None:
            for c in range(k):
                expected[:, c] += np.bincount(piece, weights=use[:, c], minlength=n + 2)

        for at, codes in by_length([SPACE + words[i] for i in few.tolist()]):
            arcs = table.arcs(codes)
            a, b = forward(arcs, p), backward(arcs, p)
            scale = weight[few[at]] / a[-1]
            for length, found in enumerate(arcs, 1):
                for i in range(found.shape[1]):
                    piece = found[:, i]
                    hit = np.flatnonzero(piece < n)
                    if len(hit):
                        count(piece[hit], a[i][hit] * p[piece[hit]] * b[i + length][hit] * scale[hit])
        for i in many.tolist():
            codes = np.frombuffer((SPACE + words[i]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[None, :]
            arcs = table.arcs(codes)
            a, b = log_forward(codes, np.array([codes.shape[1]]), table, p, every=True)[:, 0], log_backward(arcs, p, table.longest)[:, 0]
            for length, found in enumerate(arcs, 1):
                at = np.flatnonzero(found[0] < n)
                piece = found[0][at]
                count(piece, np.exp(a[at] + b[at + length] - a[-1]) * p[piece] * weight[i])
        p[:n] = (expected[:n] + smooth * n * p[:n].mean(axis=1, keepdims=True)) / (expected[:n].sum(axis=0) + smooth * n)
    total = np.array([docs[c] for c in languages], dtype=np.float64)
    return Model(languages, np.log(total / total.sum()) if k else total, p)


class Scorer:
    """A model in a worker, with the words it has scored."""

    def __init__(self, model: Model):
        self.model, self.table = model, PieceTable(vocabulary()[0])
        self.rows = np.zeros((1 << 16, len(model.languages)), dtype=np.float32)
        self.known: dict[str, int] = {}

    def score(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """Language, None where there is no letter or nothing was learned, and its posterior."""
        model, split = self.model, [words_of(t or "") for t in texts]
        if not model.languages:
            return [(None, 0.0)] * len(texts)
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        long = [w for w in fresh if len(w) >= LONGEST]
        whole = dict(zip(long, log_marginals(long, self.table, model.p), strict=True))
        new = list(fresh.difference(self.known, long))
        at, need = len(self.known), len(self.known) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((need, self.rows.shape[1]), dtype=np.float32)])
        if new:
            self.rows[at:need] = log_marginals(new, self.table, model.p)
            self.known.update(zip(new, range(at, need), strict=True))
        out = []
        for words in split:
            if not has_letter(words):
                out.append((None, 0.0))
                continue
            total = model.priors.copy()
            if whole:
                for w in words:
                    if len(w) >= LONGEST:
                        total += whole[w]
                words = [w for w in words if len(w) < LONGEST]
            total += self.rows[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            out.append((model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        if need > REMEMBERED:
            for word in new:
                del self.known[word]
        return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.name not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[model.name] = Scorer(model)
        scorer = _WORKERS[model.name]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = scorer.score(batch.column("text").to_pylist())
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(["und" if x is None else x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x is not None for x, _ in found])],
                    names=[*names, "lang_pred", "score", "answered"],
                )
        give_back()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word in words_of(text):
                seen[lang, word] = seen.get((lang, word), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"]
        )


def train(labelled: DataFrame, docs_per_language: int = 500, seed: int = 7) -> Model:
    """Fit on a sample of labelled rows (doc_id, text, lang) of about docs_per_language by language, chosen by a hash of doc_id.

    Rows whose lang or doc_id is null are not used. The sample bounds what the driver holds: the distinct words of
    docs_per_language documents for each language.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return fit({}, {})
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / float(1 << 53)
    sample = rows.filter((draw < F.element_at(share, F.col("lang"))) & F.col("text").isNotNull()).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for lang, word, n in counted.toLocalIterator():
        counts[lang][word] = n
    return fit(counts, sizes)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """keep, lang_pred, score and answered of every row of docs; only its text is looked at.

    lang_pred is one of the model's languages, or und with score 0 and not answered if the text is null, empty or has no
    letter (or if nothing was learned). score is the posterior of lang_pred, 0 to 1; ties go to the language first in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages, a fixed size
    names = {c: f"c{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()], F.col("text").cast("string").alias("text"))
    kinds = [f"{names[c]} {docs.schema[c].dataType.simpleString()}" for c in keep]
    out = rows.mapInArrow(_predict(shared), ", ".join([*kinds, "lang_pred string", "score double", "answered boolean"]))
    return out.select(*[F.col(k).alias(c) for c, k in names.items()], "lang_pred", "score", "answered")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 by 4; never those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_of(docs: DataFrame, docs_per_language: int = 500) -> DataFrame:
    """Train on the labelled rows that are not held out, predict for all: doc_id, held_out, lang_pred, score.

    docs: doc_id, text, lang; other columns are ignored. Repeated rows are predicted each by itself; rows without a
    doc_id are predicted, not trained on. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(rows.filter(~held_out(F.col("doc_id"))), docs_per_language)
    return identify(rows, model, ("doc_id",)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
