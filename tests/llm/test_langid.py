import itertools
import math
import zlib
from fractions import Fraction

import numpy as np

from loamdex.llm.langid import Model, fit, identify, language_of, log_marginals, train
from loamdex.llm.lattice import PieceTable, log_backward, log_forward, vocabulary


def test_forward_sums_all_segmentations():
    pieces, _, _ = vocabulary()
    table = PieceTable(pieces)
    rng = np.random.default_rng(1)
    p = np.zeros((len(pieces) + 2, 2))
    p[:-2] = rng.random((len(pieces), 2)) / len(pieces)
    p[-1] = 1e-7
    index = {x: i for i, x in enumerate(pieces)}
    words = ["the", "straße", "a", "nation", "\U0001f600x"]
    got = log_marginals(words, table, p)
    for w, row in zip(words, got):
        marked = "▁" + w
        for lang in range(2):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
                parts, at = [], 0
                for i, c in enumerate(cuts, 1):
                    if c:
                        parts.append(marked[at:i])
                        at = i
                parts.append(marked[at:])
                probability = 1.0
                for x in parts:
                    probability *= p[index[x], lang] if x in index else (1e-7 if len(x) == 1 else 0.0)
                total += probability
            assert math.isclose(row[lang], math.log(total), rel_tol=1e-9)


def test_long_words_are_summed_over_all_segmentations():
    """Logarithms agree with plain sums where these hold, over chunks and filled-up groups, and with exact sums beyond."""
    pieces, _, _ = vocabulary()
    table = PieceTable(pieces)
    rng = np.random.default_rng(2)
    p = np.zeros((len(pieces) + 2, 2))
    p[:-2] = rng.random((len(pieces), 2)) / len(pieces)
    p[-1] = 1e-7
    index = {x: i for i, x in enumerate(pieces)}
    words = ["".join(rng.choice(["na", "tion", "ß", "er", "😀"], size=n)) for n in (1, 4, 9, 20, 40, 120, 121, 130, 900, 5000)]
    got = log_marginals(words, table, p)
    for w, row in zip(words, got):
        marked = "▁" + w
        for lang in range(2):
            upto = [Fraction(1)]
            for j in range(1, min(len(marked), 1200) + 1):
                parts = ((upto[j - n], marked[j - n : j]) for n in range(1, min(j, table.longest) + 1))
                upto.append(sum(a * Fraction(p[index[x], lang] if x in index else 1e-7) for a, x in parts if x in index or len(x) == 1))
                upto[-1] = upto[-1].limit_denominator(10**400) if j < 100 else Fraction(upto[-1].numerator * 10**6000 // upto[-1].denominator, 10**6000)
            if len(marked) <= 1200:
                want = math.log(upto[-1].numerator) - math.log(upto[-1].denominator)
                assert math.isclose(row[lang], want, rel_tol=1e-9)
    codes = np.frombuffer(("▁" + words[-1]).encode("utf-32-le"), dtype=np.uint32)[None, :]
    for chunk in (1, 17, 100_000):
        assert np.allclose(log_forward(codes, np.array([codes.shape[1]]), table, p, chunk), got[-1])
    # backward sums from the start are the forward sums up to the end, and expected pieces of a word cover it once
    arcs = table.arcs(codes)
    a, b = log_forward(codes, np.array([codes.shape[1]]), table, p, every=True), log_backward(arcs, p, table.longest)
    assert np.allclose(a[-1], b[0])
    cover = np.zeros(codes.shape[1])
    for n, found in enumerate(arcs, 1):
        at = np.arange(found.shape[1])
        chance = np.exp(a[at, 0, 0] + b[at + n, 0, 0] - b[0, 0, 0]) * p[found[0], 0]
        for i in range(n):
            np.add.at(cover, at + i, chance)
    assert np.allclose(cover, 1)


def test_training_on_long_words_and_a_language_called_und(spark):
    model = fit({"x": {"a" * 200: 3}, "y": {"b" * 200: 3}}, {"x": 1, "y": 1})
    x, y = log_marginals(["a" * 5000, "b" * 5000], PieceTable(vocabulary()[0]), model.p)
    assert np.isfinite([x, y]).all() and x[0] > x[1] and y[1] > y[0]
    docs = spark.createDataFrame([(1, "hello " + "a" * 300), (2, "12 34")], "doc_id long, text string")
    found = identify(docs, fit({"und": {"hello": 3}}, {"und": 1}), ("doc_id",)).collect()
    assert [(r.lang_pred, r.answered) for r in found] == [("und", True), ("und", False)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language_of(docs, docs_per_language=60).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert {i: r.held_out for i, r in rows.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    out = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_only_text_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs, 30)
    one = {r.doc_id: r.lang_pred for r in identify(docs, model, ("doc_id",)).collect()}
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source")
    assert one == {r.doc_id: r.lang_pred for r in identify(other, model, ("doc_id", "lang")).collect()}


def test_odd_rows(odd, none, spark):
    got = language_of(odd[0]).collect()
    assert len(got) == len(odd[1])
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1] == by[2] == by[7] == ("und", 0.0) and by[0][0] in ("en", "de", "fr", "es")
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert language_of(none).collect() == []
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert language_of(unlabelled).first().lang_pred == "und"


def test_model_is_fixed_by_its_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = train(docs, 20), train(docs.repartition(7), 20)
    assert isinstance(a, Model) and a.languages == b.languages and np.allclose(a.p, b.p)
